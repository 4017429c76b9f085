"""Each operator on a small table of hard cases, against a brute-force version."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lagweave.llm import decontaminate, exchange, html_layout, jaccard_join, language_id, packing, substring_dedup, suffix_dedup, text, token_binary, tokens, topk, toxicity
from lagweave.llm.components import components
from lagweave.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(rows):
    return Counter(tuple(r) for r in rows)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_words_and_grams():
    texts = ["a  b c", None, "", " x\ty ", "a b c"]
    chunk = next(text.chunks(pa.array(texts)))
    w = text.words(chunk, text.SPACED)
    assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)] == ["a", "b", "c", "x", "y", "a", "b", "c"]
    assert w.offsets.tolist() == [0, 3, 3, 3, 5, 8]
    grams = text.gram_hashes(text.word_hashes(w), 3)
    assert grams[0] == grams[5] and len(set(grams.tolist())) == 5
    assert np.flatnonzero(text.gram_starts(w.offsets, 3)).tolist() == [0, 5]


def test_packed_hashes_come_back():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 1000):
        v = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) >> np.uint64(int(rng.integers(0, 60))))
        got, rest = exchange.unpack(exchange.pack(v) + b"tail")
        assert (got == v).all() and rest == b"tail"


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, rng.integers(0, 60, 2))) for _ in range(40)] + [(100, k) for k in range(101, 140)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if any(v in e and e[0] != e[1] for e in edges)}


# -- 1


def brute_top(rows, k):
    out = []
    valid = [(i, [np.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in valid if i % 5 == 0}):
        own = min(v for i, v in valid if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in valid if i != q and len(v) == len(own))[:k]
        out += [(q, r, i, int(-s)) for r, (s, i) in enumerate(scored, 1)]
    return bag(out)


def test_topk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(x) for x in rng.integers(-2, 3, 6) / 4]) for k in range(60)]
    rows += [(5, rows[5][1]), (61, None), (62, []), (63, [None] * 6), (64, [float("nan")] * 6), (65, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (70, [1.0, 2.0]), (75, [0.0] * 6), (80, rows[3][1])]
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 5)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, block int, v int")
    assert bag(topk.top_k(df, F.col("vec_id") % 5 == 0, k=7).collect()) == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0


# -- 2


def shingles(t, n):
    w = WORD.findall((t or "").translate(LOW))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = [shingles(r[1], n) for r in rows]
    label = list(range(len(rows)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), r[0]), r[0])
    return bag((r[0], len(s), least.get(find(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (2, 50)])
def test_jaccard_join(docs, rows, empty, n, percent):
    assert bag(jaccard_join.near_duplicates(docs, n, percent).collect()) == brute_components(rows, n, percent)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_jaccard_chain_of_near_copies(spark):
    """A long chain in which only neighbours link is one component."""
    words = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(0, 140, 2)] + [(999, "something else entirely here")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: 0 for k, _ in rows[:-1]} | {999: 999}


@pytest.mark.parametrize(("percent", "core", "sets"), [(85, 16, ("v l1 l2", "v u", "u y1 y2")), (80, 15, ("v l1 l2", "v u", "u y1 y2 y3"))])
def test_jaccard_links_beside_larger_members(spark, percent, core, sets):
    """The second set links the others, which do not link; what sets may not share is less for the largest sizes of the groups than for the linked ones."""
    rows = [(3 * g + k, " ".join(f"c{g}x{i}" for i in range(core)) + " " + s) for g in range(20) for k, s in enumerate(sets)]
    rows += [(1000 + k, f"v u l1 l2 y1 y2 y3 z{k}") for k in range(40)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, percent)
    assert bag(got.collect()) == brute_components(rows, 1, percent)


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (1, 60)])
def test_jaccard_all_links(spark, docs, rows, empty, n, percent):
    """Every linked pair comes back, those inside a star and between members of stars of one component too."""
    rng = np.random.default_rng(12)
    more = []
    for g in range(12):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(9):
            kept = [w if rng.random() > 0.015 else f"x{rng.integers(99)}" for w in base]
            more.append((len(rows) + len(more) + 100, " ".join(kept[: 60 - int(rng.integers(0, 6))])))
    table = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    sets = [(r[0], shingles(r[1], n)) for r in [*rows, *more] if r[0] is not None]
    want = {(a, b) for a, s in sets for b, t in sets if a < b and s and t and 100 * len(s & t) >= percent * len(s | t)}
    assert len(want) > 100
    assert bag(jaccard_join.linked_pairs(table, n, percent).collect()) == bag(want)
    assert jaccard_join.linked_pairs(empty, n, percent).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    group = {k[0]: k[2] for k in brute_components(rows, 5, 80)}
    assert sorted(i for i in ids if i is not None) == sorted({c for i, c in group.items() if i is not None})
    assert ids.count(None) == 2


def test_one_of_each_tells_rows_of_one_id_apart(spark):
    """Only the row whose own text has a near copy goes; other texts under its id stay, each once."""
    text = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d") + " end"), (4, text("d")), (5, None), (5, "")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert bag(kept.collect()) == bag([(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (5, None)])


# -- 3


def test_html():
    page = """<html><head><title>T</title><style>x</style></head><body><ul><li>one<li>two <b>bold</b><ol start=3><li>n1<li>n2</ol></ul>
    <p>Para  one<p>Para two<br>line &amp; more<div hidden>no</div><div style="display: none">no</div>
    <table><tr><th>Name<th>Value<tr><td>a<td>100</table><pre> a\n   b</pre><script>var t="</p>";</script>end</body>"""
    assert html_layout.text_of(page)[0] == "- one\n- two bold\n  3. n1\n  4. n2\n\nPara one\n\nPara two\nline & more\n\nName  Value\na     100\n\n a\n   b\n\nend"
    for broken in ("", "<", "<p", "</", "<!--", "<a href='", "&#xfffffff;", "</td></p>", "<div>" * 3000 + "x", "<table><tr><td>" * 500 + "x"):
        html_layout.text_of(broken)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<head><title>T</title><body>Hello <b>w</b>", "Hello w"),
        ("<html><head><meta charset=x> Hello <b>w</b>", "Hello w"),
        ("<head><title>T</title><textarea>seen</textarea>", "seen"),
        ("a<head>b<i>c</i>", "abc"),
        ("<table><tr><td title=it's>visible one</td><td>don't lose</td></table>", "visible one  don't lose"),
        ("<p class=a\"b>one</p><p title='x>y'>two</p><p =\"q>three</p><p a=>four", "one\n\ntwo\n\nthree\n\nfour"),
        ("one<p title='open>two", "one"),
        ("x<br/>y<a href=z/>k</a>", "x\nyk"),
        ("<svg><title/><path d='M0'/><style/><text x=1>A</text><text>B<tspan>C</tspan></text><desc>no</desc></svg>D", "A BC D"),
        ("<svg/>after <svg><path><p>out", "after\n\nout"),
        ("<svg><g><foreignObject><p>in<p>two</foreignObject></g><defs><text>no</text></defs></svg>end", "in\n\ntwo\n\nend"),
        ("<math><mi>x</mi><mo>=</mo><mspace/><mn>1</mn><annotation>no</annotation></math> and", "x=1 and"),
        ("<svg><text><![CDATA[a > b]]></text></svg>", "a > b"),
        ("<map name=m><area alt=x href=y>inside <a href=z>map</a></map>", "inside map"),
    ],
)
def test_html_keeps_visible_text(page, want):
    assert html_layout.text_of(page)[0] == want


def test_html_keeps_words(spark):
    rows = [(1, "u", "<p>a b</p>", 9), (2, None, None, 9), (3, "u", "", 9), (3, "u", "", 9), (None, "v", "<b>" + "word " * 50_000, 9)]
    got = html_layout.rendered(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert bag((r["page_id"], r["text"] and len(r["text"].split())) for r in got) == Counter({(1, 2): 1, (2, None): 1, (3, ""): 2, (None, 50_000): 1})


# -- 4


def brute_hits(rows, items, window):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    places = {}
    for name, t in items:
        w = split(t)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            places.setdefault(tuple(w[k : k + window]), set()).add(name)
    out = []
    for r in rows:
        w, hit, names = split(r[1]), set(), set()
        for size in {len(p) for p in places}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in places:
                    hit |= set(range(k, k + size))
                    names |= places[tuple(w[k : k + size])]
        out.append((r[0], len(w), len(hit), len(names), sha(",".join(sorted(names)).encode()), bool(hit)))
    return bag(out)


def brute_longest(rows, items, window):
    """Per text its longest run of words that is also in an item and holds a whole window of it: words, first word, least item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    parts = [(name, split(t)) for name, t in items]
    out = []
    for r in rows:
        w, best = split(r[1]), None
        for name, v in parts:
            at = {}
            for j, x in enumerate(v):
                at.setdefault(x, []).append(j)
            for i in range(len(w)):
                for j in at.get(w[i], ()):
                    if i and j and w[i - 1] == v[j - 1]:
                        continue
                    k = 0
                    while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                        k += 1
                    if k >= min(window, len(v)):
                        best = min(best or (0, 0, ""), (-k, i, name))
        out.append((r[0], *((-best[0], *best[1:]) if best else (0, None, None))))
    return bag(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination(spark, docs, rows, empty, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    passage = " ".join(rows[30][1].split()[15:50])
    items = [("1", passage), ("2", "a B"), ("3", None), ("4", " "), ("1", "W1 w2, w3!"), ("10", rows[12][1]), ("x", "same same same")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    got = decontaminate.contamination(docs, bench).collect()
    assert bag(tuple(r)[:6] for r in got) == brute_hits(rows, items, 10)
    assert bag((r["doc_id"], *tuple(r)[6:]) for r in got) == brute_longest(rows, items, 10)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for r, n in brute_hits(rows, items, 10).items() if not r[5])
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    best = {r["item_id"]: r for r in decontaminate.longest_matches(docs, bench).collect()}
    assert best["10"]["length"] == len(rows[12][1].split()) and best["10"]["doc_id"] == 12


def test_longest_matches_of_any_length(spark):
    """Against brute force: matches below a window, at an item's end, and ties."""
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 25, n))
    docs = [(int(k), prose(40)) for k in rng.permutation(30)] + [(None, prose(60)), (70, None), (71, "only here zz")]
    items = [(str(k), prose(int(rng.integers(1, 30)))) for k in range(25)] + [("end", "q1 q2 q3 only here zz"), ("none", "q1 q2 q3"), ("null", None)]
    want = {}
    for name, t in items:
        w = (t or "").split()
        hits = []
        for d, x in docs:
            v = (x or "").split()
            for i in range(len(w)):
                for j in range(len(v)):
                    k = 0
                    while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                        k += 1
                    if k:
                        hits.append((-k, d is None, d or 0, j, i, d))
        if hits:
            k, _, _, j, i, d = min(hits)
            want[name] = (i, -k, d, j)
    got = decontaminate.longest_matches(spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id string, text string"))
    assert {r["item_id"]: tuple(r)[1:] for r in got.collect()} == want


# -- 5 and 10


@pytest.fixture(scope="module")
def ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [np.array(e.ids, "<u4") for e in t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)]


def test_tokens_equal_the_library(ids, rows):
    got = []
    for _, flat, offsets in tokens.encoded(pa.array([r[1] for r in rows]), tokenizer_file(), 5):
        got += [flat[a:b] for a, b in zip(offsets, offsets[1:])]
    assert all((a == np.append(b, 5)).all() for a, b in zip(got, ids)) and len(got) == len(ids)


def test_tokens_fuzz():
    import random

    from tokenizers import Tokenizer

    rng = random.Random(2)
    alphabet = "ab'sStTreLL 012१ \t\n\r\x0b\x0c\x1c\x85  é é éÉ×÷İΣς$%<-|endoftext|>’漢Á"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["a<|endoftext|>b"]
    want = Tokenizer.from_file(tokenizer_file()).encode_batch(texts, add_special_tokens=False)
    got = []
    for _, flat, offsets in tokens.encoded(pa.array(texts), tokenizer_file(), 5):
        got += [flat[a : b - 1].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [e.ids for e in want]


def test_packing(docs, rows, ids, empty):
    got = packing.packed(docs, tokenizer_file()).toPandas()
    whole = Counter((r[0], len(i) + 1) for r, i in zip(rows, ids))
    assert got.length.sum() == sum(len(i) + 1 for i in ids)
    assert Counter((None if np.isnan(d) else int(d), n) for d, n in got[got.start == 0][["doc_id", "doc_tokens"]].itertuples(index=False)) == whole
    by_doc = {r[0]: np.append(i, 1).astype("<u4") for r, i in zip(rows, ids)}
    for r in got[got.doc_id.notna()].itertuples():
        assert r.ids_crc32 == zlib.crc32(by_doc[int(r.doc_id)][r.start : r.start + r.length].tobytes())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.max() + 1))
    assert packing.packed(empty, tokenizer_file()).count() == 0


def test_patterns_hold_the_histogram():
    rng = np.random.default_rng(4)
    h = Counter(int(n) for n in np.minimum(rng.geometric(0.003, 5000), 2048))
    found = packing.patterns(h)
    assert sum((Counter({n: c * k.count(n) for n in set(k)}) for k, c in found), Counter()) == h
    assert max(sum(k) for k, _ in found) <= 2048
    packs = sum(c for _, c in found)
    assert packs <= 1.01 * sum(n * c for n, c in h.items()) / 2048 + 1
    assert packing.padded(2048) == 2048 and packing.padded(512) == 512 and packing.padded(513) == 2048


def test_token_files(docs, rows, ids, empty, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 500)
    got = token_binary.round_trip(docs, tokenizer_file()).toPandas().sort_values("start")
    assert got.start.tolist() == [0, *np.cumsum(got.n_tokens)[:-1]]
    assert got.doc_id.dropna().is_monotonic_increasing and got.doc_id[:2].isna().all()
    want = Counter((r[0], len(i) + 1, zlib.crc32(np.append(i, 2).astype("<u4").tobytes())) for r, i in zip(rows, ids))
    assert Counter((None if np.isnan(d) else int(d), n, c) for d, n, c in got[["doc_id", "n_tokens", "ids_crc32"]].itertuples(index=False)) == want
    assert token_binary.round_trip(empty, tokenizer_file()).count() == 0


def test_token_block_is_checked():
    counts = np.array([0, 3, 4, 993])
    ranks = np.random.default_rng(0).integers(0, 2**32, 1000).astype(np.uint32) >> np.random.default_rng(1).integers(0, 30, 1000).astype(np.uint32)
    control, data, _, _ = token_binary.encode(ranks, counts)
    block = token_binary.block_bytes(np.arange(4), counts, control, data)
    assert (token_binary.read_block(block)[2] == ranks).all()
    with pytest.raises(ValueError, match="whole"):
        token_binary.read_block(block[:-1] + bytes([block[-1] ^ 1]))


# -- 6 and 8


def test_toxicity_learns_and_ignores_held_out_labels(spark, docs, empty):
    rng = np.random.default_rng(5)
    clean = lambda: " ".join(f"c{k}" for k in rng.integers(0, 300, 40))
    rows = [(k, clean() + (" you idiot scum" if k % 4 == 0 else " zorblax" if k % 4 == 1 else "")) for k in range(800)]
    labels = spark.createDataFrame([(k, int(k % 4 < 2), 1) for k, _ in rows] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.scored(table, labels).toPandas()
    fold = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)
    assert (got.held_out == fold).all()
    own = got[got.held_out]
    assert ((own.predicted == 1) == (own.doc_id % 4 < 2)).mean() > 0.97
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.scored(table, other).toPandas()
    assert dict(zip(got.doc_id, got.score)) == dict(zip(again.doc_id, again.score))
    assert toxicity.scored(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert toxicity.scored(empty, labels).count() == 0


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(6)
    truth = rng.random(4000) < 0.3
    vote = lambda acc: np.where(rng.random(4000) < acc, np.where(truth, 1, -1), np.where(truth, -1, 1))
    good, fair = vote(0.9), vote(0.8)
    weak = vote(0.65)
    model = toxicity.LabelModel.fit(np.stack([good, fair, vote(0.85), weak, weak, weak], axis=1), 0.3)
    assert model.weight[3] < 0.5 * model.weight[0]
    assert ((model.posterior(np.stack([good, fair, vote(0.85), weak, weak, weak], axis=1)) > 0.5) == truth).mean() > 0.9


def test_language(spark, docs, empty):
    rng = np.random.default_rng(8)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["the", "ing", "shr"], "cc": ["üb", "ßen", "ach"], "dd": ["ción", "ñe", "os"]}
    make = lambda p: " ".join("".join(rng.choice(p, 3)) for _ in range(30))
    rows = [(k, make(parts[lang]), lang, 1) for k, lang in enumerate(list(parts) * 60)]
    rows += [(1000, None, "aa", 1), (1001, "", "aa", 1), (1002, "12 ?!", "aa", 1), (1003, make(parts["bb"]), None, 1), (None, make(parts["cc"]), "dd", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    got = language_id.identified(table).toPandas()
    sure = got[got.doc_id < 1000]
    assert (sure.lang_pred == sure.doc_id.map(lambda d: list(parts)[int(d) % 4])).mean() > 0.99
    assert set(got[got.doc_id.isin([1000, 1001, 1002])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert (sure.held_out == sure.doc_id.map(lambda d: zlib.crc32(str(int(d)).encode()) % 4 == 2)).all()
    kept = language_id.recognised(table)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert {r["lang_pred"] for r in language_id.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language_id.identified(empty).count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 5, 12, 40):
        code = language_id.codewords(n)
        apart = (code[:, None] != code[None]).sum(2) + 1000 * np.eye(n, dtype=int)
        assert apart.min() >= (1 if n == 2 else 2 if n == 3 else 4)


# -- 7 and 9


def brute_windows(rows, window):
    split = [WORD.findall(r[1] or "") for r in rows]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, split):
        gone = {k + n for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for n in range(window)}
        out.append((r[0], len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode())))
    return bag(out)


@pytest.mark.parametrize("window", [35, 6])
def test_substring_dedup(docs, rows, empty, window):
    assert bag(substring_dedup.repeats(docs, window).collect()) == brute_windows(rows, window)
    assert substring_dedup.repeats(empty).count() == 0


def test_deduplicated_keeps_columns(docs, rows):
    got = substring_dedup.deduplicated(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    untouched = {k[0] for k in brute_windows(rows, 35) if k[2] == 0}
    texts = {r[0]: r[1] for r in rows}
    assert all(r["text"] == texts[r["doc_id"]] for r in got.collect() if r["doc_id"] in untouched and r["doc_id"] is not None)
    emptied = sum(n for k, n in brute_windows(rows, 35).items() if k[1] and k[1] == k[2])
    assert got.count() == len(rows) - emptied


def brute_bytes(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for r, b in zip(rows, data):
        edge = np.zeros(len(b) + length + 1, int)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                edge[k] += 1
                edge[k + length] -= 1
        gone = np.cumsum(edge)[: len(b)] > 0
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((r[0], len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return bag(out)


@pytest.mark.parametrize(("length", "gram", "crowd"), [(400, 64, 4096), (40, 8, 4096), (40, 8, 1)])
def test_suffix_dedup(docs, rows, empty, length, gram, crowd):
    assert bag(suffix_dedup.repeats(docs, length, gram, crowd).collect()) == brute_bytes(rows, length)
    assert suffix_dedup.repeats(empty).count() == 0


def test_suffix_sort_is_lexicographic():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 99, 300).astype(np.uint8)
    start = rng.permutation(300)[:120]
    group = np.sort(rng.integers(0, 5, 120))
    stop = np.minimum(start + rng.integers(0, 60, 120), 300)
    order = suffix_dedup.suffix_sort(suffix_dedup.Hashed(data), start, stop, group)
    key = lambda i: (group[i], data[start[i] : stop[i]].tobytes())
    assert [key(i) for i in order] == sorted(key(i) for i in range(120))
