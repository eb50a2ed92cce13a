import random
import re

import pytest

from ledgerline.llm import decontamination
from ledgerline.llm.common import LOWER_TABLE

DOCS = "doc_id long, text string, row int, n_words int, items string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER_TABLE))


def plain(docs, items, window=10):
    """Brute force over all windows: (id, words, hit words, item ids, spans)."""
    wanted = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[i : i + window]), set()).add(name)
    sizes, out = sorted({len(w) for w in wanted}), []
    for name, text in docs:
        w, hit, found = words(text), set(), set()
        for i in range(len(w)):
            for n in sizes:
                if i + n <= len(w) and (own := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        spans = [(i, next(j for j in range(i, len(w) + 1) if j not in hit)) for i in sorted(hit) if i - 1 not in hit]
        out.append((name, len(w), len(hit), sorted(str(x) for x in found if x is not None), spans))
    return out


def found(spark, docs, items, **more):
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS).repartition(3)
    bench = spark.createDataFrame([(i, t, "row") for i, t in items], "item_id long, text string, id string")
    got = decontamination.find_contamination(frame, bench, **more).collect()
    return [(r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in got]


key = lambda rows: sorted(map(repr, rows))


def tables(seed, letters="abcd"):
    """Few words, so that windows overlap, repeat and share most of their words."""
    r = random.Random(seed)
    some = lambda n: [r.choice(letters) for _ in range(n)]
    items = [(i, " ".join(some(r.choice([1, 2, 3, 9, 10, 11, 25])))) for i in range(4, 20)] + [(4, " ".join(some(12))), (None, " ".join(some(11))), (21, None), (22, ""), (23, "?!"), (5, "A-b c_D 7é x Y z 漢 w v")]
    docs = [(i, " ".join(some(r.randint(0, 60)))) for i in range(40)]
    for i in range(40, 70):
        _, text = r.choice(items[:18])
        docs.append((i, ", ".join([*some(5), text, *some(5)]).upper()))
    return docs + [(70, None), (71, ""), (72, "..."), (3, "a b"), (3, "a b"), (None, items[0][1]), (74, "x" * 30_000), (75, "a b c d " * 3000), (76, "..A b C d7É X y\nz\t漢\x00W(v) a-b c d 7é x y z 漢 w v")], items


@pytest.mark.parametrize("letters", ["abcd", [f"w{i}" for i in range(40)]])
def test_against_every_window(spark, letters, monkeypatch):
    docs, items = tables(len(letters), letters)
    long = [x for x in items if len(words(x[1])) >= 10 or not words(x[1])]
    for own, window in ((items, 10), (long, 10), (items, 4), (items[:1], 1)):
        assert key(found(spark, docs, own, window=window)) == key(plain(docs, own, window))


def test_many_automata_and_pieces_of_items(spark, monkeypatch):
    docs, items = tables(5)
    items.append((99, " ".join(random.Random(6).choices("abcd", k=400))))
    docs.append((99, "zz " + items[-1][1]))
    frame, bench = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontamination, "PIECE", 40)
    files = decontamination.write_automata(bench.coalesce(1), block=60)
    assert len(files) > 5
    monkeypatch.setattr(decontamination, "write_automata", lambda *_: files)
    got = decontamination.find_contamination(frame, bench).collect()
    assert key((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in got) == key(plain(docs, items))
    assert max(decontamination._load(f).length[-1] for f in files) <= 40


def test_tables_without_rows_or_words(spark):
    docs, items = tables(7)
    assert found(spark, [], items) == []
    for nothing in ([], [(1, None), (2, ""), (3, "- -")]):
        assert key(found(spark, docs, nothing)) == key(plain(docs, nothing))


def test_slices_of_long_texts(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000)) + " "
    monkeypatch.setattr(decontamination, "SLICE", 1000)
    assert [w.decode() for some in decontamination.words_of(decontamination.plain(text)) for w in some] == words(text)


def test_longest_match(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, "x " + " ".join(f"w{i}" for i in range(5, 22)) + " y w1 w2"), (2, "w1 w2 w3")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    got = {r.doc_id: (r.longest, r.n_hit, [tuple(s) for s in r.spans]) for r in decontamination.find_contamination(docs, bench).collect()}
    assert got == {1: (17, 17, [(1, 18)]), 2: (0, 0, [])}


def test_removal_cuts_spans_and_drops_what_is_mostly_hit(spark):
    item, clean = "One two, three four; five six seven eight nine ten eleven.", "Ünrelated words stand here and there, " * 3
    rows = [(1, f"{clean}(ONE two three four five six seven eight nine ten eleven!) {clean}", 5), (2, item, 6), (3, clean, 7), (4, None, 8), (4, None, 8), (5, "", 9), (6, f"{clean} short one {clean}", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, `odd name` int")
    bench = spark.createDataFrame([(1, item), (2, "short one")], "item_id long, text string")
    got = decontamination.remove_contamination(docs, bench, text_col="body")
    assert got.columns == docs.columns
    want = [(1, f"{clean}(!) {clean}", 5), (3, clean, 7), (4, None, 8), (4, None, 8), (5, "", 9), rows[-1]]
    assert key(map(tuple, got.collect())) == key(want)
    shorter = decontamination.remove_contamination(docs, bench, text_col="body", least_words=2, most_share=1.0)
    assert {r.doc_id: r.body for r in shorter.collect()} == {1: f"{clean}(!) {clean}", 2: ".", 3: clean, 4: None, 5: "", 6: f"{clean}  {clean}"}
