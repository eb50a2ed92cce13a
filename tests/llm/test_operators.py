import functools
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import ann, bpe, components, exact_dedup, langid, mixing, ppm, simhash, substring_dedup, token_shards, warc
from ledgerline.llm.common import LOWER_TABLE, shared_dir

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, digest string"


def docs(spark, texts, **more):
    """Documents with two columns more whose names the operators use inside."""
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER_TABLE))


ODD = [None, "", " \n\t", "a", "Same Text", "same text", "SAME text", "Éa éA", "éa éa", "x" * 50_000, "word " * 5_000, "a b", "Ünï 漢字 🙂   z", "0 1 2", "$$$"]


def test_exact_dedup_of_odd_rows(spark):
    frame = docs(spark, ODD).union(docs(spark, ODD[:1]))  # doc 0 twice
    got = exact_dedup.exact_dedup(frame).collect()
    groups = defaultdict(list)
    for r in frame.collect():
        groups[(r.text or "").translate(LOWER_TABLE)].append(r.doc_id)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in got) == want


def test_exact_dedup_compares_contents_when_digests_collide(spark):
    frame = docs(spark, ["aa", "bb", "AA", "ccc", "bb", None])
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(frame, digest=lambda t: F.length(t).cast("string")).collect()}
    assert got == {0: (2, 2), 1: (4, 2), 2: (2, 2), 3: (3, 1), 4: (4, 2), 5: (5, 1)}
    assert exact_dedup.exact_dedup(frame.limit(0)).count() == 0
    nulls = frame.withColumn("doc_id", F.lit(None).cast("long")).filter("text = 'bb'")
    assert [(r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(nulls).collect()] == [(None, 2, True)] * 2


def fuzz(n, seed=1):
    r = random.Random(seed)
    letters = [*"ab 's  '\n\t\x85 éß漢字١²½ǅ🙂 ​　_-<|>.,", "<|endoftext|>", "the ", " and", "'re", "  ", "\r\n", "123"]
    return ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(n)] + ["a" * 5000, " " * 3000, "<|endoftext|>", "x <|endoftext|>  y", "", "ab" * 3000]


def test_bpe_round_trip_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = [*fuzz(3000), None]
    got = {r.doc_id: r for r in bpe.bpe_columns(docs(spark, texts).repartition(3), PATH, ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids), text
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(got[i].decoded.encode()).hexdigest()
    again = bpe.bpe_decode(spark.createDataFrame([(1, [15496, 995]), (2, None), (3, [])], "doc_id int, ids array<int>"), PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == {1: "Hello world", 2: None, 3: ""}
    assert bpe.bpe_columns(docs(spark, []), PATH).count() == 0


def test_bpe_cache_is_bounded():
    coder = bpe.BpeCodec(PATH)
    coder.remember = 50
    texts = [f"w{i} w{i % 7} again" for i in range(400)]
    for start in range(0, 400, 40):
        want = bpe.BpeCodec(PATH).encode(texts[start : start + 40])
        assert list(coder.encode(texts[start : start + 40])) == list(want)
        assert len(coder.known) <= 50 + 90


def test_language_profiles(spark):
    r = random.Random(2)
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "éêàçu"}
    rows = [(i, " ".join("".join(r.choices(alphabets[k], k=5)) for _ in range(30)), k) for i, k in enumerate(["xx", "yy", "zz"] * 20)]
    frame = spark.createDataFrame([*rows, (100, None, "xx"), (101, "12 $$", "xx"), (102, "abcde", None), (103, "漢", "xx")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    profiles = langid.train_profiles(frame.filter(langid.fold(F.col("doc_id"), 3) != 1))
    counts = Counter()
    for i, text, k in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and k == "zz":
            padded = [f" {w} " for w in text.split()]
            counts.update(c for c in text if c != " ")
            counts.update(w[j : j + 2] for w in padded for j in range(len(w) - 1))
            counts.update(w[j : j + 3] for w in padded for j in range(len(w) - 2))
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - j)) for j, c in enumerate(g))
    want = sorted(counts, key=lambda g: (-counts[g], code(g)))[:300]
    assert profiles["zz"] == [code(g) for g in want]
    got = {r.doc_id: r for r in langid.identify(frame, profiles).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in rows)
    assert [got[i].lang_pred for i in (100, 101)] == ["und", "und"] and got[100].score == 0
    assert {x.lang_pred for x in langid.identify(frame, {}).collect()} == {"und"} and langid.train_profiles(frame.limit(0)) == {}


def plain_grams(text):
    """n-grams of one to three letters with their counts, of lower-cased words padded with blanks; by code points."""
    line, counts = "".join(c if c.isalpha() else " " for c in text.lower()), Counter()
    for w in (f" {w} " for w in line.split()):
        counts.update(c for c in w if c != " ")
        counts.update(w[j : j + 2] for j in range(len(w) - 1))
        counts.update(w[j : j + 3] for j in range(len(w) - 2))
    return counts


def ranked(counts, size=langid.PROFILE):
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - j)) for j, c in enumerate(g))
    return sorted(counts, key=lambda g: (-counts[g], code(g)))[:size]


def plain_language(rows, held_out=1):
    """rows: (id, text, lang). The prediction and score of each, by profiles of the rows whose fold is not held out."""
    sums = defaultdict(Counter)
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != held_out and text is not None and lang is not None:
            sums[lang].update(plain_grams(text))
    profiles = {k: {g: r for r, g in enumerate(ranked(v))} for k, v in sorted(sums.items()) if v}
    out = {}
    for i, text, _ in rows:
        top = ranked(plain_grams(text or ""))
        if not top or not profiles:
            out[i] = ("und", 0.0)
            continue
        off = {k: sum(abs(p[g] - r) if g in p else langid.PROFILE for r, g in enumerate(top)) for k, p in profiles.items()}
        best = min(profiles, key=lambda k: (off[k], k))
        out[i] = (best, 1 - off[best] / (langid.PROFILE * len(top)))
    return out


def test_out_of_place_distances(spark):
    r = random.Random(21)
    alphabets = {"xx": "abcdeé", "yy": "defghÉ", "zz": "éêàçuß"}
    rows = [(i, " ".join("".join(r.choices(alphabets[k], k=r.randint(1, 9))) for _ in range(r.randint(1, 60))), k) for i, k in enumerate(["xx", "yy", "zz"] * 25)]
    rows += [(200, None, "xx"), (201, "12 $$", "yy"), (202, "a-b'c 漢字", None), (203, "Ab " * 40_000, "xx"), (204, rows[0][1], "zz"), (205, "ǅ ſ İ", "xx")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    frame = frame.union(frame.filter("doc_id in (3, 203)"))
    profiles = langid.train_profiles(frame.filter(langid.fold(F.col("doc_id"), 3) != 1))
    got = langid.identify(frame, profiles).collect()
    want = plain_language([*rows, *(x for x in rows if x[0] in (3, 203))])
    assert len(got) == len(rows) + 2
    assert [(x.lang_pred, pytest.approx(x.score)) for x in got] == [want[x.doc_id] for x in got]


def targets(sizes, most=3):
    """By water-filling, source by source."""
    order = sorted((k for k in sizes if k is not None)) + [k for k in sizes if k is None]
    weight = {k: i % 3 + 1 for i, k in enumerate(order)}
    left, open_, out = sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[k] for k in open_)
        over = [k for k in open_ if level * weight[k] > most * sizes[k]]
        if not over:
            return out | {k: level * weight[k] for k in open_}
        for k in over:
            out[k] = most * sizes[k]
            left -= out[k]
            open_.discard(k)
    return out


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, "w " * r.randint(0, 60), "big" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 5}" if i % 7 else "tiny" if i == 7 else "s1") for i in range(900)] + [(900, None, "empty"), (900, None, "empty")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(frame, shards=4).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for row in got:
        sizes[row.source] += row.size
        taken[row.source] += row.size * len(row.draws)
        assert len(row.draws) <= 3 and row.size == len(words(dict((a, b) for a, b, _ in rows)[row.doc_id])) and len({d["pass"] for d in row.draws}) == len(row.draws)
    want = targets(dict(sizes))
    for row in got:
        assert row.target == pytest.approx(want[row.source]) and row.source_size == sizes[row.source]
    for k in sizes:
        assert abs(taken[k] - want[k]) <= 60, k
    again = mixing.mix_sources(frame.repartition(5), shards=4).collect()
    key = lambda x: (x.doc_id, str(x.draws))
    assert sorted(map(key, again)) == sorted(map(key, got))
    shards = Counter(d["shard"] for row in got for d in row.draws)
    assert set(shards) == {0, 1, 2, 3} and max(shards.values()) < 1.5 * min(shards.values())
    copies = mixing.emit_shards(mixing.mix_documents(frame, shards=4)).collect()
    assert Counter((c.doc_id, c.mix_shard, c.mix_pass, c.mix_key) for c in copies) == Counter((r.doc_id, d["shard"], d["pass"], d["key"]) for r in got for d in r.draws)
    nulls = spark.createDataFrame([(None, "a b", None)] * 50 + [(1, "c d", "s")] * 3, "doc_id long, text string, source string")
    assert mixing.mix_documents(nulls).count() == sum(len(r.draws) for r in mixing.mix_sources(nulls).collect()) <= 3 * 53
    assert mixing.mix_sources(frame.limit(0)).count() == 0


def test_shard_quotas_are_hypergeometric(spark):
    quotas = spark.createDataFrame([("a", 40), ("b", 24), (None, 0)], "source string, quota long")
    left = []
    for seed in range(12):
        got = mixing.shard_quotas(quotas, 2, f"seed{seed}").collect()
        by = defaultdict(dict)
        for r in got:
            by[r.shard][r.source] = (r.quota, r.first)
        assert sum(q for q, _ in by[0].values()) == 32 and by[0]["a"][0] + by[1]["a"][0] == 40 and by[1]["a"][1] == by[0]["a"][0]
        left.append(by[0]["a"][0])
    assert len(set(left)) > 2 and abs(np.mean(left) - 20) < 2.5


def plain_share(u, rest, n, free):
    """By inversion, from the likeliest outcome upwards and then downwards, with exact weights."""
    from fractions import Fraction

    weight = lambda k: math.comb(n, k) * math.comb(rest - n, free - k)
    low, high = max(0, free - (rest - n)), min(n, free)
    mode = max(low, min(high, (n + 1) * (free + 1) // (rest + 2)))
    place, total = Fraction(u) * math.comb(rest, free), 0
    for k in [*range(mode, high + 1), *range(mode - 1, low - 1, -1)]:
        total += weight(k)
        if total > place:
            return k
    raise AssertionError


def test_shard_quotas_follow_the_tree(spark):
    quotas = [("a", 4000), ("b", 377), ("c", 1), ("d", 0), ("e", 52), (None, 900)]
    for shards in (2, 8):
        nodes = {0: [n for _, n in quotas]}
        for level in range(shards.bit_length() - 1):
            below = {}
            for node, held in nodes.items():
                rest, free, left = sum(held), sum(held) // 2, []
                for n in held:
                    u = int(hashlib.md5(f"s|{level}|{node}|{len(left)}".encode()).hexdigest()[:12], 16) / 16**12
                    left.append(plain_share(u, rest, n, free))
                    rest, free = rest - n, free - left[-1]
                below |= {2 * node: left, 2 * node + 1: [n - k for n, k in zip(held, left, strict=True)]}
            nodes = below
        got = {(r.source, r.shard): (r.quota, r.first) for r in mixing.shard_quotas(spark.createDataFrame(quotas, "source string, quota long"), shards, "s").collect()}
        assert {k: q for k, (q, _) in got.items()} == {(name, node): held[i] for node, held in nodes.items() for i, (name, _) in enumerate(quotas)}
        assert all(got[k, s + 1][1] == got[k, s][0] + got[k, s][1] for k, _ in quotas for s in range(shards - 1))
        assert max(map(sum, nodes.values())) - min(map(sum, nodes.values())) <= shards


def test_mix_keeps_columns_whose_names_it_uses(spark):
    frame = spark.createDataFrame([(i, "a b c", "s", i, -i, "x", 7) for i in range(20)], "doc_id long, text string, source string, _of int, block int, row string, mix_shard int")
    got = mixing.mix_documents(frame)
    assert got.columns == ["doc_id", "text", "source", "_of", "block", "row", "mix_shard", "mix_pass", "mix_key"]
    rows = got.collect()
    assert len(rows) == 20 and all((r["_of"], r["block"], r["row"]) == (r.doc_id, -r.doc_id, "x") for r in rows) and {r.mix_shard for r in rows} == {0, 1}


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, fps, radius=2):
    best = dict(zip(ids, ids, strict=True))
    changed = True
    while changed:
        changed = False
        for i, a in zip(ids, fps, strict=True):
            low = min(best[j] for j, b in zip(ids, fps, strict=True) if (a ^ b).bit_count() <= radius)
            changed |= low < best[i]
            best[i] = low
    return best


def test_simhash_components(spark):
    r = random.Random(4)
    base = [" ".join(r.choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=r.randint(1, 400))) for _ in range(25)]
    texts = [*ODD, *base, *(t.replace("alpha", "ALPHA", 3) for t in base[:5]), *(t + " tail" for t in base), *(t.replace("beta", "betas", 1) for t in base)]
    frame = docs(spark, texts)
    want = reach(range(len(texts)), [plain_fingerprint(t) for t in texts])
    for tree in (1000, 1):  # trees, and the other exact way for crowded shards
        got = {x.doc_id: x for x in simhash.near_duplicates(frame, tree=tree).collect()}
        assert {i: int(x.fingerprint, 16) for i, x in got.items()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
        assert {i: x.component_id for i, x in got.items()} == want
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_of_crowded_fingerprints(spark):
    r = random.Random(5)
    centre = r.getrandbits(64)
    values = {centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(300)} | {r.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    ids = sorted(signed)
    want = reach(ids, [v & (1 << 64) - 1 for v in ids])
    for tree in (1000, 20):
        labels = {x.node: x.label for x in components.connected_components(simhash.links_within(frame, tree=tree)).collect()}
        assert {v: labels.get(v, v) for v in ids} == want


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(6)
    values = list({r.getrandbits(16) for _ in range(500)})
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        for radius in (0, 2, 5):
            assert {tree.values[i] for i in tree.within(q, radius)} == {v for v in values if (v ^ q).bit_count() <= radius}


def test_long_chains_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.label for r in components.connected_components(links).collect()}
    assert set(got.values()) == {0, 500} and len(got) == 203


class Counted(io.BytesIO):
    read_bytes = 0

    def read(self, size=-1):
        got = super().read(size)
        self.read_bytes += len(got)
        return got


def test_wavelet_matrix():
    r = np.random.default_rng(7)
    for tokens in (r.integers(0, 50_000, 3000), np.zeros(700, int), np.array([5]), np.array([], int), r.integers(0, 3, 2000)):
        data = b"".join(token_shards.dump(tokens.astype(np.uint32), np.array([len(tokens)])))
        matrix, counts, ids = token_shards.load(io.BytesIO(data))
        assert matrix.tokens().tolist() == tokens.tolist() and counts.tolist() == [len(tokens)] and ids == [0]
        file = Counted(data)
        ranged, _ = token_shards.open_matrix(file)
        if len(tokens) > 2000:  # from the file's own ranges
            file.read_bytes = 0
            assert [ranged[i] for i in (5, len(tokens) - 1)] == tokens[[5, -1]].tolist() and file.read_bytes < len(data) / 2
            assert ranged.rank(int(tokens[9])) == int((tokens == tokens[9]).sum()) and ranged.select(int(tokens[9]), 0) == int(np.flatnonzero(tokens == tokens[9])[0])
        for i in r.integers(0, max(1, len(tokens)), 60).tolist() if len(tokens) else []:
            symbol = int(tokens[i])
            assert matrix[i] == symbol and matrix.rank(symbol, i) == int((tokens[:i] == symbol).sum()) and matrix.select(symbol, matrix.rank(symbol, i)) == i
        assert matrix.rank(49_999_999) == 0


def test_token_shards(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    texts = [*fuzz(300, 8), None, *ODD]
    frame = docs(spark, texts).repartition(3)
    for most in (200, 10**6):
        folder = shared_dir(spark)
        files = token_shards.write_token_shards(frame, PATH, folder, 2, shard_tokens=most)
        got = {r.doc_id: r for r in token_shards.read_token_shards(spark, folder).collect()}
        assert files.agg(F.sum("n_docs")).first()[0] == len(got) == len(texts)
        start = 0
        for i, text in enumerate(texts):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
            assert (got[i].start, got[i].n_tokens, list(got[i].tokens)) == (start, len(ids), ids)
            assert got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            start += len(ids)
    # Rows that share an id, or have none: the latter first, then by id and text.
    odd = spark.createDataFrame([(3, "b b"), (3, "a"), (None, "z"), (3, None), (None, "y"), (1, "x")], "doc_id long, text string")
    folder = shared_dir(spark)
    token_shards.write_token_shards(odd, PATH, folder, 2, shard_tokens=4)
    got = sorted(token_shards.read_token_shards(spark, folder).collect(), key=lambda r: r.start)
    want = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in ("y", "z", "x", "", "a", "b b")]
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3] and [list(r.tokens) for r in got] == want
    folder = shared_dir(spark)
    token_shards.write_token_shards(frame.limit(0), PATH, folder, 2)
    assert token_shards.read_token_shards(spark, folder).count() == 0


def test_warc_chains(spark):
    inner = warc.record(1, "http://inner", b"payload").decode()
    rows = [(i, f"http://x/{i}?a b\n", inner * (i % 4) + "y" * (i * 37 % 900)) for i in range(50)]
    rows += [(100, None, None), (101, "u", "z" * 1500), (102, "u", "z" * 1500), (103, "u", "z" * 999), (104, "u", "z" * 999), (105, "u", "é" * 600), (106, "u", "é" * 600), (107, "u", "WARC/1.1\r\n\r\n" + inner * 40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers", F.lit(1)).repartition(3)
    folder = shared_dir(spark)
    assert warc.write_warc(warc.plan_records(frame), folder) == len(rows)
    for step in (50, 700, 10**7):
        got = {r.record_id: r for r in warc.read_warc(spark, folder, step).collect()}
        assert len(got) == len(rows)
        for i, _, html in rows:
            r, data = got[f"<urn:page:{i}>"], (html or "").encode()
            again = {101: 102, 105: 106}.get(i)
            assert (r.record_type, r.refers_to) == (("revisit", f"<urn:page:{again}>") if again else ("response", None))
            assert r.payload_bytes == len(data) and r.payload_sha1 == hashlib.sha1(data).hexdigest() and bytes(r.payload) == (b"" if again else data)
    nothing = shared_dir(spark)
    assert warc.write_warc(warc.plan_records(frame.limit(0)), nothing) == 0 and warc.read_warc(spark, nothing).count() == 0


def test_warc_plan_keeps_other_columns_of_any_name(spark):
    rows = [(1, "u", "p" * 1200, 1, 2, 3, "x", 4), (2, None, "p" * 1200, 5, 6, 7, None, 8), (None, "u", "p" * 1200, 1, 2, 3, "x", 4), (None, "v", "q" * 1200, 1, 2, 3, "x", 4), (None, "w", "q" * 1200, 1, 2, 3, "x", 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, _winner int, _key int, _bytes int, refers_to string, _SIZE0 int")
    got = warc.plan_records(frame)
    assert sorted(got.columns) == sorted(frame.columns)
    want = [(*r[:6], {"p": None if r[0] == 2 else 2}.get(r[2][0]), r[7]) for r in rows]
    assert sorted(map(repr, map(tuple, got.select(frame.columns).collect()))) == sorted(map(repr, want))


def test_warc_ranges_are_dealt_to_all_tasks(spark):
    rows = [(i, "u", "p" * 2000) for i in range(300)] + [(7, "u", "q" * 1200), (7, None, "q" * 1200), (None, "u", "r")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    folder = shared_dir(spark)
    assert warc.write_warc(warc.plan_records(frame), folder) == len(rows)
    read = warc.read_warc(spark, folder, 1500, with_payload=False)
    tasks, used = read.rdd.getNumPartitions(), read.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 2 * 4 and used >= 0.75 * tasks  # four shuffle partitions, eight ranges a task
    got = Counter((r.record_id, r.record_type, r.payload_bytes) for r in read.collect())
    # Of equal payloads one response; rows that repeat the winning id are responses too.
    assert got[("<urn:page:7>", "response", 1200)] == 2 and got[("<urn:page:>", "response", 1)] == 1 and got[("<urn:page:299>", "response", 2000)] == 1
    assert sum(got.values()) == len(rows) and sum(n for (_, kind, _), n in got.items() if kind == "revisit") == 299


def test_warc_errors(spark):
    from ledgerline.llm.common import write_file

    for data in (b"junk" + warc.record(1, None, b"x"), warc.record(1, None, b"x") + b"junk", warc.record(1, None, b"abc").replace(b"\r\n\r\nabc", b"\r\n\r\nabd")):
        folder = shared_dir(spark)
        write_file(f"{folder}/a.warc", [data])
        with pytest.raises(Exception, match="record|digest"):
            warc.read_warc(spark, folder).collect()


def plain_ppm(counted):
    """counted: the training texts as bytes."""
    seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for text in counted:
        line = ppm.LEAD + text + ppm.END
        for i in range(ppm.ORDER, len(line)):
            for k in range(ppm.ORDER + 1):
                seen[k][line[i - k : i]][line[i]] += 1

    @functools.cache
    def cost(string):
        out, total = set(), 0.0
        for k in range(ppm.ORDER, -1, -1):
            left = {s: n for s, n in seen[k].get(string[ppm.ORDER - k : -1], {}).items() if s not in out}
            if not left:
                continue
            whole = sum(left.values())
            if string[-1] in left:
                return total + math.log10((left[string[-1]] - 0.5) / whole)
            total += math.log10(len(left) / 2 / whole)
            out |= set(left)
        return total - math.log10(256 - len(out))

    def score(text):
        line = ppm.LEAD + text + ppm.END
        return sum(cost(line[i - ppm.ORDER : i + 1]) for i in range(ppm.ORDER, len(line)))

    return score


def test_ppm_scores(spark, monkeypatch):
    r = random.Random(9)
    texts = [*ODD, *(" ".join("".join(r.choices("abcdé", k=r.randint(1, 7))) for _ in range(r.randint(0, 60))) for _ in range(40))]
    frame = docs(spark, texts)
    fold = langid.fold(F.col("doc_id"), 7) == 2
    tokens = {i: [*(w.encode() for w in words(t)), b"\n"] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    lines = {i: b" ".join(ws[:-1]) for i, ws in tokens.items()}
    n, v, score = sum(counts.values()), len(counts), plain_ppm([lines[i] for i in lines if not out[i]])
    assert any(out.values())
    # The query's own settings, many blocks and buckets, and sums in many rounds for blocks that ask apart.
    for sizes in ({}, {"block": 3000, "bucket": 7000}, {"block": 2000, "bucket": 20_000, "fan": 3, "spread": 5}):
        got = {x.doc_id: x for x in ppm.ppm_scores(frame, fold, **sizes).collect()}
        assert len(got) == len(texts)
        for i, ws in tokens.items():
            x = got[i]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out[i], len(ws), sum(counts[w] > 0 for w in ws), n)
            assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
            assert x.score == pytest.approx(score(lines[i]))


def test_ppm_tells_the_order_of_words(spark):
    r = random.Random(19)
    line = "the cat sat on a mat and then the dog ran off".split()
    texts = [" ".join(line)] * 20 + [" ".join(r.sample(line, len(line))) for _ in range(5)] + [" ".join(line), " ".join(line[::-1])]
    frame = docs(spark, texts).union(docs(spark, [None, texts[0]]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = ppm.ppm_scores(frame, F.coalesce(F.col("doc_id"), F.lit(25)) >= 25).collect()
    got = {x.doc_id: x.score for x in rows}
    assert len(rows) == 29 and got[25] > got[26] + 3 and got[25] == got[0]
    assert [x.n_tokens for x in rows if x.doc_id is None and x.n_tokens == 1] == [1] and sum(x.score == got[0] for x in rows) == 22


def test_strings_are_cut_alike_in_steps(monkeypatch):
    lines = [b"abc", b"", b"defghij kl", b"m" * 50]
    whole = np.concatenate(list(ppm.strings_of(lines))).tolist()
    padded = [(ppm.LEAD + x + ppm.END)[i : i + 5] for x in lines for i in range(len(x) + 1)]
    assert [int(x).to_bytes(5, "big") for x in whole] == padded
    for step in (1, 7, 16):
        monkeypatch.setattr(ppm, "STEP", step)
        assert np.concatenate(list(ppm.strings_of(lines))).tolist() == whole


def test_ppm_probabilities_sum_to_one():
    strings = np.concatenate(list(ppm.strings_of([b"abra cadabra abra", b"bar bar barn", b"x"])))
    model = ppm.PpmModel(*np.unique(strings, return_counts=True))
    for context in (ppm.LEAD, b"abra", b"zzzz", b" bar", b"rn\nx"):
        head = np.uint64(int.from_bytes(context, "big")) << np.uint64(8)
        assert (10 ** model.log10(head | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1)


def test_ppm_deals_common_pairs_and_bounds_what_a_task_takes(spark):
    """Texts that all have the pair "ab" after many bytes: its strings are in many buckets, and no sum takes more than `fan` rows of one."""
    r = random.Random(29)
    texts = [" ".join(f"{chr(r.randint(97, 122))}{chr(r.randint(97, 122))}ab{chr(r.randint(97, 122))}" for _ in range(400)) for _ in range(30)]
    strings = np.unique(np.concatenate([np.concatenate(list(ppm.strings_of([t.encode()]))) for t in texts]))
    after = strings[(strings >> np.uint64(8)) & ppm.MASKS[2] == int.from_bytes(b"ab", "big")]
    shares = np.bincount(ppm._string_bucket(after, 8), minlength=8) / len(after)
    assert len(after) > 5000 and shares.max() < 0.4
    pieces = spark.createDataFrame([(b, k, b"", b"", after[k::50].tobytes(), np.ones(len(after[k::50]), "<i8").tobytes()) for b in range(3) for k in range(50)], ppm.PIECES)
    plans, made = [], ppm.materialize
    try:
        ppm.materialize = lambda rows: plans.append(made(rows)) or plans[-1]
        out = ppm._summed(pieces, 50, 3, 4)
    finally:
        ppm.materialize = made
    assert [p.count() for p in plans] == [3 * 13, 3 * 4, 3]
    for row in out.collect():
        assert row.block == -1 and np.array_equal(np.frombuffer(row.strings, "<u8"), after) and set(np.frombuffer(row.string_counts, "<i8").tolist()) == {1}


def test_ppm_without_training(spark):
    frame = docs(spark, ["ab", None])
    got = {r.doc_id: r for r in ppm.ppm_scores(frame, F.lit(True)).collect()}
    assert got[1].n_tokens == 1 and got[1].n_known == 0 and got[0].base_score == 0 and got[0].score == pytest.approx(-3 * math.log10(256))
    assert ppm.ppm_scores(frame.limit(0), F.lit(False)).count() == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(10)
    centres = r.normal(size=(8, 16)) * 3
    data = {i: (centres[i % 8] + r.normal(size=16)).tolist() for i in range(600)}
    data |= {600 + i: data[0] for i in range(30)} | {700: [0.0] * 16, 701: None, 702: [1.0] * 15 + [None], 703: [float("nan")] * 16, 704: [1.0, 2.0]}
    frame = spark.createDataFrame([(i, v, 1) for i, v in data.items()], "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(9))
    good = {i: np.array(v) for i, v in data.items() if i < 700}
    for tree in (16_384, 64):
        got = defaultdict(list)
        for x in ann.nearest_neighbours(frame, F.col("vec_id") % 100 == 0, tree=tree).collect():
            got[x.query_id].append((x.rank, x.vec_id, x.score))
        hits = 0
        for q in (i for i in good if i % 100 == 0):
            want = sorted((float(np.sqrt(((good[i] - good[q]) ** 2).sum())), i) for i in good if i != q)[:10]
            mine = sorted(got[q])
            assert [m[0] for m in mine] == list(range(1, 11)) and [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
            assert all(s == pytest.approx(float(np.sqrt(((good[i] - good[q]) ** 2).sum()))) for _, i, s in mine)
            hits += len({i for _, i in want} & {m[1] for m in mine})
        assert hits >= 0.9 * 10 * len(got) and len(got) == 7
        assert [m[1] for m in sorted(got[0])] == list(range(600, 610))
    # Rows that share an id: each is a candidate, and each asks.
    same = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [1.5, 0.0]), (100, [3.0, 0.0]), (100, [3.0, 0.5])], "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x.rank, x.vec_id, round(x.score, 3)) for x in ann.nearest_neighbours(same, F.col("vec_id") % 100 == 0, k=2).collect())
    assert got == [(0, 1, 1, 0.5), (0, 2, 1, 1.0), (100, 1, 100, 0.5), (100, 1, 100, 0.5), (100, 2, 1, 1.0), (100, 2, 1, 1.118)]
    few = frame.filter("vec_id < 3")
    assert ann.nearest_neighbours(few, F.col("vec_id") % 100 == 0).count() == 2 and ann.nearest_neighbours(few.limit(0), F.lit(True)).count() == 0
    assert ann.chi_square_cdf(ann.stop_ratio(0.95, 8), 8) == pytest.approx(0.95)


def test_neighbours_of_clusters_are_found_without_looking_at_all(spark):
    r = np.random.default_rng(20)
    vectors = (r.normal(size=(60, 32)) * 4)[r.integers(0, 60, 12_000)] + r.normal(size=(12_000, 32)) * 0.7
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(frame, F.col("vec_id") % 100 == 0, tree=1000, with_work=True).collect()
    work = {x.query_id: x.verified for x in got}
    assert len(work) == 120 and np.mean(list(work.values())) < 0.1 * len(vectors) and max(work.values()) < 0.3 * len(vectors)
    hits = 0
    for q in work:
        off = ((vectors - vectors[q]) ** 2).sum(axis=1)
        off[q] = np.inf
        hits += len({x.vec_id for x in got if x.query_id == q} & set(np.argsort(off)[:10].tolist()))
    assert hits >= 0.9 * 10 * len(work)


def plain_cuts(data):
    table, top = substring_dedup.TABLE, (1 << 32) - 1
    hashes = [sum(int(table[data[i - j]]) << j for j in range(min(substring_dedup.GEAR, i + 1))) % (1 << 32) for i in range(len(data))]
    reach_ = substring_dedup.REACH
    cut = lambda i: hashes[i] < min(hashes[max(0, i - reach_) : i], default=top) and hashes[i] <= min(hashes[i + 1 : i + 1 + reach_], default=top)
    return [i + 1 for i in range(len(data) - 1) if cut(i)] + [len(data)]


def test_chunks():
    r = random.Random(11)
    for n in (1, 5, 30, 200, 1500):
        data = bytes(r.choices(b"ab cde", k=n))
        assert substring_dedup.chunk_ends(data).tolist() == plain_cuts(data)
    assert substring_dedup.chunk_ends(b"").size == 0 and max(np.diff(substring_dedup.chunk_ends(b"a" * 20_000))) <= substring_dedup.MOST
    data = bytes(r.choices(range(97, 123), k=3000))
    pieces = lambda d: {d[a:b] for a, b in zip([0, *substring_dedup.chunk_ends(d)[:-1]], substring_dedup.chunk_ends(d), strict=True)}
    assert len(pieces(data) & pieces(data[:1500] + b"insertion" + data[1500:])) > 0.9 * len(pieces(data))


def test_repeated_passages(spark):
    r = random.Random(12)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    passage = text(60)
    own = [text(120) for _ in range(40)]
    texts = [f"{t[:200]} {passage} {t[200:]}" if i < 12 else t for i, t in enumerate(own)] + [None, "", "é" * 300, own[30]]
    frame = docs(spark, texts)
    found = substring_dedup.repeated_passages(frame)
    got = {x.doc_id: x for x in found.collect()}
    assert len(got) == len(texts) and {i for i, x in got.items() if x.has_repeat} == {*range(12), 30, 43}
    assert got[0].removed_bytes == 0 and got[0].repeated_bytes > 0.5 * len(passage) and got[5].removed_bytes > 0.5 * len(passage)
    assert got[43].kept_bytes == 0 and got[30].removed_bytes == 0 and got[40].text_bytes == 0
    cut = {x.doc_id: x.text for x in substring_dedup.cut_passages(frame).collect()}
    assert cut[43] == "" and cut[40] is None and cut[20] == texts[20] and len(cut[5].encode()) == got[5].kept_bytes
    assert substring_dedup.repeated_passages(frame.limit(0)).count() == 0


def plain_passages(rows, least=substring_dedup.PASSAGE):
    """rows: (id, text), in the table's order. What repeated_passages tells of each, by position."""
    cuts = [[*zip([0, *(e := substring_dedup.chunk_ends((t or "").encode()).tolist())[:-1]], e, strict=True)] if t else [] for _, t in rows]
    places = defaultdict(list)
    for at, ((i, t), own) in enumerate(zip(rows, cuts, strict=True)):
        for a, b in own:
            places[t.encode()[a:b]].append((i is None, i or 0, at, a))
    out = []
    for at, ((_, t), own) in enumerate(zip(rows, cuts, strict=True)):
        runs, end = [], None
        for a, b in own:
            chunk = places[t.encode()[a:b]]
            if len(chunk) > 1:
                if end != a:
                    runs.append([])
                runs[-1].append((a, b, min(chunk)[2:] == (at, a)))
                end = b
        runs = [x for x in runs if x[-1][1] - x[0][0] >= least]
        gone = [(a, b) for x in runs for a, b, stays in x if not stays]
        size, removed = len((t or "").encode()), sum(b - a for a, b in gone)
        out.append((size, bool(runs), len(runs), sum(x[-1][1] - x[0][0] for x in runs), removed, size - removed, gone))
    return out


def test_passages_of_rows_that_share_an_id(spark):
    r = random.Random(13)
    text = lambda n: " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 9))) for _ in range(n))
    a, b = text(150), text(150)
    rows = [(1, a), (5, a), (5, a), (5, b + a), (None, a), (None, b), (None, None), (3, b + b), (7, "x" * 9000)]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, removed int").coalesce(1)
    got = substring_dedup.repeated_passages(frame).collect()
    plain = lambda x: (x.text_bytes, x.has_repeat, x.n_passages, x.repeated_bytes, x.removed_bytes, x.kept_bytes, [tuple(s) for s in x.removed])
    key = lambda x: repr(x)
    assert sorted(((x.doc_id, *plain(x)) for x in got), key=key) == sorted(((i, *p) for (i, _), p in zip(rows, plain_passages(rows), strict=True)), key=key)
    assert all(0 <= x.kept_bytes <= x.text_bytes for x in got)
    cut = {x.removed: x.text for x in substring_dedup.cut_passages(frame).collect()}
    assert len(cut) == len(rows) and cut[0] == a and cut[1] == cut[2] == "" and cut[6] is None
    assert [len((cut[k] or "").encode()) for k in range(len(rows))] == [p[5] for p in plain_passages(rows)]
