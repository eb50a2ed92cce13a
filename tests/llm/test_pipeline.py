import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def test_every_operator_has_one_query():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@needs_tables
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SMALL).select(want.columns).collect()
    plain = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else "~" if x is None else x for x in r) for r in rows)
    key = lambda rows: sorted(map(repr, plain(rows)))
    assert key(map(tuple, got)) == key(want.fetchall())


@needs_tables
def test_queries_match_brute_force(spark):
    """Those without SQL, over the whole smallest tables."""
    import hashlib
    import zlib
    from collections import Counter

    import numpy as np
    from test_operators import PATH, plain_fingerprint, plain_language, plain_passages, plain_ppm, reach, words
    from tokenizers import Tokenizer

    library, digest = Tokenizer.from_file(PATH), lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    run = lambda n: entry.queries()[n](spark, SMALL).collect()
    by = lambda n: {r.doc_id: r for r in run(n)}

    want = plain_passages([(i, t) for i, t, _ in rows])
    got = by("op1_gear_substring_dedup")
    assert [(x.text_bytes, x.has_repeat, x.n_passages, x.repeated_bytes, x.removed_bytes, x.kept_bytes, x.n_removed) for x in (got[i] for i, *_ in rows)] == [(*w[:6], len(w[6])) for w in want]

    encoded = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, _ in rows}
    got = by("op3_trie_bpe")
    assert {i: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for i, x in got.items()} == {i: (len(e), digest(",".join(map(str, e))), digest(library.decode(e, skip_special_tokens=False))) for i, e in encoded.items()}

    start, got = 0, by("op7_wavelet_token_shards")
    for i, e in sorted(encoded.items()):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(e) + 1, zlib.crc32(np.array([*e, 2], "<u4").tobytes()))
        start += len(e) + 1

    got, want = by("op5_rank_order_language"), plain_language(rows)
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and x.lang_pred == want[i][0] and abs(x.score - want[i][1]) < 1e-12 for i, x in got.items()) and len(got) == len(rows)

    own = {i: [w.encode() for w in words(t)] for i, t, _ in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in own}
    counts = Counter(w for i in own if not out[i] for w in [*own[i], b"\n"])
    score, n = plain_ppm([b" ".join(own[i]) for i in own if not out[i]]), sum(counts.values())
    got = by("op9_ppm_scoring")
    for i, x in got.items():
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(own[i]) + 1, sum(counts[w] > 0 for w in [*own[i], b"\n"]), n)
        assert x.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (n + len(counts) + 1)) for w in [*own[i], b"\n"])) and x.score == pytest.approx(score(b" ".join(own[i])))

    ids, prints = [i for i, *_ in rows], [plain_fingerprint(t) for _, t, _ in rows]
    assert {i: (x.fingerprint, x.component_id) for i, x in by("op10_simhash_bk_tree").items()} == {i: (f"{f:016x}", low) for (i, low), f in zip(reach(ids, prints).items(), prints, strict=True)}

    vectors = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    found, hits = run("op4_projected_kd_neighbours"), 0
    queries = [i for i in vectors if i % 100 == 0]
    for q in queries:
        exact = sorted((float(np.sqrt(((v - vectors[q]) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        mine = sorted((x.rank, x.vec_id, x.score) for x in found if x.query_id == q)
        assert [m[0] for m in mine] == list(range(1, len(exact) + 1)) and all(s == pytest.approx(float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum()))) for _, i, s in mine)
        hits += len({i for _, i in exact} & {i for _, i, _ in mine})
    assert hits >= 0.9 * 10 * len(queries)


def plain_kept(rows):
    """rows: (id, text, lang) with distinct ids. What the first three stages keep, stage by stage."""
    from test_jaccard import plain_components
    from test_operators import plain_language

    from ledgerline.llm.common import LOWER_TABLE

    told = plain_language(rows, held_out=None)
    rows = [x for x in rows if told[x[0]][0] != "und" and told[x[0]][1] > 0]
    yield [i for i, *_ in rows]
    last = {(t or "").translate(LOWER_TABLE): (i, t) for i, t, _ in sorted(rows)}
    rows = sorted(last.values())
    yield [i for i, _ in rows]
    lowest = plain_components([t for _, t in rows])  # ascending ids, so the first place is the smallest id
    yield [i for at, (i, _) in enumerate(rows) if lowest[at] == at]


@needs_tables
def test_run_keeps_what_plain_python_keeps(spark):
    import hashlib
    from collections import Counter

    from test_operators import PATH
    from tokenizers import Tokenizer

    from ledgerline.llm.mixing import mix_sources

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    *_, kept = plain_kept(rows)
    drawn = mix_sources(docs.filter(F.col("doc_id").isin(kept))).select("doc_id", F.size("draws").alias("n")).collect()
    library, digest = Tokenizer.from_file(PATH), lambda x: hashlib.sha256(x.encode()).hexdigest()
    texts, want = {i: t for i, t, _ in rows}, Counter()
    for x in drawn:
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        want[(x.doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))] = x.n
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == +want and len({x.doc_id for x in got}) > 50


@needs_tables
def test_stages_keep_what_plain_python_keeps(spark):
    from ledgerline.llm.common import LOWER_TABLE

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.orderBy("doc_id").first()
    shout = first.text.translate({v: k for k, v in LOWER_TABLE.items()})
    odd = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "$$ 12", "en", None, 5), (9003, None, "fr", "s", 1), (9004, shout, first.lang, first.source, 1)]
    kept = docs.unionByName(spark.createDataFrame([*odd, odd[-1]], docs.schema))
    rows = {r.doc_id: (r.doc_id, r.text, r.lang) for r in kept.collect()}
    for (_, stage), want in zip(corpus_pipeline.STAGES, plain_kept(list(rows.values())), strict=False):
        kept = corpus_pipeline.materialize(stage(spark, kept, SMALL))
        assert kept.columns == corpus_pipeline.COLUMNS
        got = [r.doc_id for r in kept.select("doc_id").collect()]
        assert sorted(set(got)) == sorted(want)
    assert len(got) == len(set(got)) and first.doc_id not in got and 9004 in got


def test_exact_stage_keeps_texts_that_share_an_id(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(5, "xx aa", "a", "s", 1), (5, "yy bb", "a", "s", 1), (7, "xx aa", "a", "s", 1), (7, "XX aa", "a", "s", 1), (7, "xx aa", "a", "s", 1), (None, "yy bb", "a", "s", 1), (None, "zz", "b", "s", 1), (None, "zz", "a", "s", 1)]
    got = sorted((r.doc_id or 0, r.text, r.lang) for r in corpus_pipeline.exact(spark, spark.createDataFrame(rows, schema), "").collect())
    assert got == [(0, "zz", "a"), (5, "yy bb", "a"), (7, "XX aa", "a")]


def test_mix_stage_writes_its_shards_in_order(spark):
    from ledgerline.llm.mixing import mix_sources

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), "a", f"s{i % 4}", 1) for i in range(400)], schema)
    keys = sorted((d["shard"], d["key"], r.doc_id) for r in mix_sources(docs).collect() for d in r.draws)
    got = [r.doc_id for r in corpus_pipeline.materialize(corpus_pipeline.mixed(spark, docs, "").withColumn("at", F.monotonically_increasing_id())).orderBy("at").collect()]
    assert got == [i for *_, i in keys] and len({s for s, *_ in keys}) > 1 and got != sorted(got)


def test_stages_with_nameless_rows_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra int"
    rows = [(None, "Nameless letters here", "en", None, 1, 1)] * 3 + [(None, "other nameless letters", None, "s", 1, 1), (1, "OTHER nameless letters", "en", "s", 1, 1), (2, "a b c d", "en", "s", 1, 1)]
    kept = spark.createDataFrame(rows, schema)
    got = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = corpus_pipeline.materialize(stage(spark, kept, SMALL))
        got.append(sorted((r.doc_id or 0, r.text) for r in kept.collect()))
    assert len(got[0]) == 6
    assert got[1] == got[2] == [(0, "Nameless letters here"), (1, "OTHER nameless letters"), (2, "a b c d")]
    mixed = corpus_pipeline.materialize(corpus_pipeline.mixed(spark, kept, SMALL))
    assert corpus_pipeline.tokens(spark, mixed, SMALL).count() == mixed.count() >= 1
    nothing = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        nothing = corpus_pipeline.materialize(stage(spark, nothing, SMALL))
    assert nothing.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_stage_keeps_one_row_of_a_group_whatever_its_ids(spark):
    base = [f"w{i}" for i in range(100)]
    near = lambda n: " ".join([*base[:n], "new", *base[n + 1 :]])
    texts = [(3, " ".join(base)), (5, near(50)), (5, "another text of few words"), (None, near(70)), (None, "nameless and alone in here"), (None, "nameless and alone in here"), (8, near(20))]
    rows = [(i, t, "en", "s", 1) for i, t in texts]
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near(spark, spark.createDataFrame(rows, COLUMNS), "").collect())
    assert got == sorted((i or 0, t) for i, t in {texts[0], texts[2], texts[4]})
    again = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near(spark, spark.createDataFrame(rows[1:2] + rows[3:], COLUMNS), "").collect())
    assert again == sorted((i or 0, t) for i, t in {texts[1], texts[4]})


def test_language_stage_learns_from_all_labelled_rows(spark):
    import zlib

    held_out = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(1, "plain english words and more of them", "en", "s", 1), (held_out, "这是一个中文文本", "zh", "s", 1), (2, "12 $$", "en", "s", 1)]
    frame = spark.createDataFrame(rows, COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.language(spark, frame, "").collect()} == {1, held_out}
    assert corpus_pipeline.language(spark, frame.withColumn("lang", F.lit(None).cast("string")), "").count() == 0
