import random

import corpus_pipeline
from ledgerline.llm import components, jaccard, simhash


def plain_components(texts, shingle=5, similarity=0.8):
    """Brute force: every pair of texts, then chains."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    best = list(range(len(texts)))
    links = [(i, j) for i in best for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(best[i], best[j])
            changed |= best[i] != best[j]
            best[i] = best[j] = low
    return best


def mutated(r, words, changes):
    words = list(words)
    for i in r.sample(range(len(words)), changes):
        words[i] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def near_texts(r):
    """Texts with copies of 1 to 12 changed words in 200: similarities on both sides of 0.8; and one crowded group."""
    texts = ["", " ", "a", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(30):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        texts += [" ".join(base), *(mutated(r, base, n) for n in (1, 3, 4, 5, 6, 12))]
    base = [f"w{r.randrange(3000)}" for _ in range(120)]
    texts += [mutated(r, base, r.randint(0, 3)) for _ in range(60)]
    r.shuffle(texts)
    return texts


def test_near_copies_against_every_pair(spark):
    texts = near_texts(random.Random(11))
    frame = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id long, text string")
    want = plain_components(texts)
    for blocks in ({}, {"block_sets": 3}, {"block_hashes": 500}):  # buckets of one block, and of many
        got = jaccard.near_copies(frame, **blocks).collect()
        assert len(got) == len(texts) + 2
        assert {x.doc_id: x.component_id for x in got if x.doc_id is not None} == dict(enumerate(want))
    assert jaccard.near_copies(frame.limit(0)).count() == 0


def test_pipeline_drops_copies_of_similarity_08(spark):
    r = random.Random(12)
    rows = []
    for i in range(20):
        base = [f"w{r.randrange(3000)}" for _ in range(200)]
        rows += [(i, " ".join(base)), (100 + i, mutated(r, base, 4)), (200 + i, mutated(r, base, 12))]
    want = plain_components([t for _, t in rows])
    kept = {rows[i][0] for i, low in enumerate(want) if i == low}
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.near(spark, frame, "").collect()} == kept
    assert len(kept) == 40


def test_links_within_a_block_join_what_all_pairs_join():
    r = random.Random(13)
    for _ in range(20):
        base = [f"w{r.randrange(500)}" for _ in range(60)]
        texts = list({mutated(r, base, r.randint(0, 4)) for _ in range(40)})
        sets = [jaccard.shingle_set(t) for t in texts]
        top = list(range(len(texts)))
        links = jaccard.block_links(sets)
        for _ in texts:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        assert top == plain_components(texts) and len(links) == len(texts) - len(set(top))


def templates(r, n, own=25):
    """Texts that share 60 words and have some of their own: no two are similar enough."""
    shared = [f"t{i}" for i in range(60)]
    return [" ".join([*shared, *(f"w{r.randrange(10**6)}" for _ in range(own))]) for _ in range(n)]


def test_texts_of_one_template_do_not_meet_all_blocks(spark, monkeypatch):
    asked, plain_asking, keys, plain_keys = [], jaccard._asking, [], jaccard._rare_keys
    monkeypatch.setattr(jaccard, "_asking", lambda apart: asked.append(1) or plain_asking(apart))
    monkeypatch.setattr(jaccard, "_rare_keys", lambda *a: keys.append(plain_keys(*a)) or keys[-1])
    r = random.Random(14)
    for n in (200, 600):
        texts = templates(r, n)
        copies = [mutated(r, t.split(), 1) for t in texts[:20]]
        got = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts + copies)), "doc_id long, text string"), block_sets=16).collect()
        assert {x.doc_id: x.component_id for x in got} == dict(enumerate(list(range(n)) + list(range(20))))
    rows = [k.count() for k in keys]
    assert len(rows) == 2 and rows[1] < 4 * max(rows[0], 100) and not asked


def test_sets_that_stay_apart_on_rare_hashes_meet_all_their_blocks(spark, monkeypatch):
    """A small vocabulary of parts: dissimilar texts of which each rare hash is shared by many."""
    r = random.Random(15)
    parts = [" ".join(f"p{i}w{j}" for j in range(12)) for i in range(12)]
    texts = [" ".join(parts[i] for i in sorted(r.sample(range(12), 8))) for _ in range(120)]
    texts += [mutated(r, t.split(), 1) for t in texts[:40]]
    r.shuffle(texts)
    asked, plain = [], jaccard._asking
    monkeypatch.setattr(jaccard, "_asking", lambda apart: asked.append(1) or plain(apart))
    got = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_sets=4).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate(plain_components(texts)))


def test_what_simhash_trees_chain_is_one_bucket(spark, monkeypatch):
    r = random.Random(16)
    base = [f"w{r.randrange(3000)}" for _ in range(900)]
    texts = [" ".join(base), *(mutated(r, base, 1) for _ in range(12)), *(" ".join(f"v{r.randrange(3000)}" for _ in range(200)) for _ in range(5))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    chains = {x.doc_id: x.component_id for x in simhash.near_duplicates(frame).collect()}
    bands, deal = [], jaccard._deal
    monkeypatch.setattr(jaccard, "_deal", lambda keys, *a: bands.append(keys) or deal(keys, *a))
    node = {x.doc_id: x.node for x in jaccard.near_copies(frame).collect()}
    keys = {}
    for x in bands[0].collect():
        keys.setdefault(x.node, []).append(x.key)
    assert all(len(k) == jaccard.BANDS + 1 for k in keys.values())
    chained = [(i, low) for i, low in chains.items() if i != low]
    assert len(chained) > 3 and all(keys[node[i]][-1] == keys[node[low]][-1] for i, low in chained)


def test_rare_hashes_are_told_without_a_row_a_pair(spark, monkeypatch):
    plans, plain = [], jaccard.materialize
    nodes = spark.createDataFrame([(i, i % 3, i % 2 == 0) for i in range(60)], "node long, label long, asks boolean")
    sets = spark.createDataFrame([(i, [*range(20), 100 + i % 7, 200 + i]) for i in range(60)], "node long, hashes array<long>")
    monkeypatch.setattr(jaccard, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    got = {(x.node, x.key): (x.n, x.total) for x in jaccard._rare_keys(nodes, sets, 0.8).collect()}
    # Of 22 hashes the 5 rarest count: the own one, which no other component has, one of a seventh, and three of all.
    want = {(i, k): (n, 22 * n) for i in range(0, 60, 2) for k, n in [(100 + i % 7, sum(j % 7 == i % 7 for j in range(60))), (0, 60), (1, 60), (2, 60)]}
    assert got == want
    assert len(plans) == 1 and plans[0].count("Join") == 1  # the sets with their labels, a row a set


def test_new_links_are_merged_without_reading_the_old_ones_again(spark, monkeypatch):
    r = random.Random(17)
    for n in (0, 30, 120):
        old, new = ([(r.randrange(200), r.randrange(200)) for _ in range(k)] for k in (120, n))
        frames = [spark.createDataFrame(x, "a long, b long") for x in (old, new)]
        got = components.merge_components(components.connected_components(frames[0]), frames[1]).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, components.connected_components(frames[0].union(frames[1])).collect()))
    linked, plain = [], components.connected_components
    for module in (jaccard, components):
        monkeypatch.setattr(module, "connected_components", lambda links: linked.append(links.filter("a <> b").count()) or plain(links))
    texts = templates(r, 200)
    texts += [mutated(r, t.split(), 1) for t in texts[:60]]
    got = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_sets=16).collect()
    assert {x.doc_id: x.component_id for x in got} == dict(enumerate([*range(200), *range(60)]))
    # The SimHash chains, the bands' links, and of the rare hashes' links only those between components.
    assert len(linked) == 3 and linked[2] < linked[1]
