"""Texts made to fool hashes, and operators against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from lagweave.llm import decontaminate, exchange, html_layout, jaccard_join, language_id, substring_dedup, suffix_dedup, text, token_binary, tokens, topk, toxicity
from lagweave.llm.components import components
from lagweave.llm.queries import tokenizer_file


def thue_morse(n, a, b):
    out, flip = a, str.maketrans({a: b, b: a})
    while len(out) < n:
        out += out.translate(flip)
    return out[:n]


PAIRS = [("b", "g"), ("<", "r"), ("a", "b")]


@pytest.fixture(scope="module")
def twins():
    return [(thue_morse(n, a, b), thue_morse(n, b, a)) for a, b in PAIRS for n in (256, 512, 1024)]


def test_hashes_of_patterns(twins):
    for x, y in twins:
        for chunk in text.chunks(pa.array([x, y, f"{x} {y}"])):
            codes = text.word_hashes(text.words(chunk, text.SPACED))
            assert codes[0] == codes[2] != codes[1] == codes[3]
        data = np.frombuffer((x + y).encode(), np.uint8)
        rolled = suffix_dedup.rolling(data, 256)
        assert rolled[0] != rolled[len(x)] and (len(x) > 256 or len(set(rolled.tolist())) == len({(x + y)[k : k + 256] for k in range(len(rolled))}))
        h = suffix_dedup.Hashed(data)
        n = len(x)
        assert h.common(np.array([0]), np.array([n]), np.array([n]), np.array([2 * n]))[0] == 0


def test_grams_of_patterns():
    """Words in a Thue-Morse order: all runs of 32 to 64 words that differ have different hashes."""
    order = thue_morse(4096, "0", "1")
    for chunk in text.chunks(pa.array([" ".join(order)])):
        codes = text.word_hashes(text.words(chunk, text.SPACED))
    for n in (18, 32, 35, 64):
        got = text.gram_hashes(codes, n)
        seen = {}
        for k, h in enumerate(got.tolist()):
            assert seen.setdefault(order[k : k + n], h) == h
        assert len(set(seen.values())) == len(seen)


def test_suffix_dedup_leaves_patterns_alone(spark):
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choice("cdefhijkl") for _ in range(n))
    rows = []
    for k in range(40):
        a, b = PAIRS[k % 2]
        head, tail = letters(72), letters(72)
        rows += [(2 * k, head + thue_morse(256, a, b) + tail), (2 * k + 1, head + thue_morse(256, b, a) + tail)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert docs.where("length(text) = 400").count() == 80
    for crowd in (1024, 1):
        assert suffix_dedup.repeats(docs, crowd=crowd).where("n_removed > 0").count() == 0


def brute_bytes(rows, length):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = Counter()
    for d, t in rows:
        b, gone = (t or "").encode(), set()
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone.update(range(k, k + length))
        spans = sum(1 for k in gone if k - 1 not in gone)
        out[d, len(b), len(gone), spans, hashlib.sha256(bytes(c for k, c in enumerate(b) if k not in gone)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [1024, 2, 0])
def test_suffix_dedup_in_crowds(spark, crowd):
    """Many different contexts around one gram, decided by sort or, in crowds, by strings: the same result as brute force."""
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    middle, rows = word(30), []
    for k in range(25):
        left, right = word(40), word(40)
        rows.append((k, left + middle + right))
        if k % 3 == 0:
            rows.append((100 + k, word(9) + left[12:] + middle + right[: rng.randrange(5, 40)] + word(5)))
    rows += [(200, thue_morse(200, "b", "g")), (201, thue_morse(200, "g", "b")), (202, None), (203, ""), (204, "ab" * 90), (205, rows[0][1]), (206, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in suffix_dedup.repeats(docs, 50, 16, crowd).collect())
    assert got == brute_bytes(rows, 50)


def test_tokens_of_patterns(twins):
    from tokenizers import Tokenizer

    path = tokenizer_file()
    texts = [t for pair in twins for t in pair] + [" ".join(t for pair in twins for t in pair)]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = [ids[a : b - 1].tolist() for _, ids, offsets in tokens.encoded(pa.array(texts), path, 1) for a, b in zip(offsets, offsets[1:])]
    assert got == want


def test_cached_runs_are_compared(monkeypatch):
    """With a hash of three values nearly all runs collide with kept ones, and still get their own ids."""
    from tokenizers import Tokenizer

    path = tokenizer_file()
    encoder = tokens.Encoder(path)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    monkeypatch.setattr(tokens, "word_hashes", lambda w: (w.end - w.start).astype(np.uint64))
    library = Tokenizer.from_file(path)
    for x in words + words[::-1]:
        for chunk in text.chunks(pa.array([x])):
            assert encoder.ids(chunk)[0].tolist() == library.encode(x, add_special_tokens=False).ids


def test_other_operators_of_patterns(spark, twins):
    rows = [(k, f"{t} one two three four five six seven eight nine ten " + " ".join(f"w{k}x{i}" for i in range(40))) for k, t in enumerate(t for pair in twins for t in pair)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([("i", twins[1][0])], "item_id string, text string")
    assert {r["doc_id"] for r in decontaminate.contamination(docs, bench).where("contaminated").collect()} == {k for k, t in rows if twins[1][0] in t.split()}
    same = [f"{x} {' '.join(f'c{i}' for i in range(3))}" for pair in twins[:3] for x in pair]
    sets = spark.createDataFrame(list(enumerate(same)), "doc_id long, text string")
    assert all(r["component_id"] == r["doc_id"] for r in jaccard_join.near_duplicates(sets).collect())
    words = [thue_morse(64, "0", "1"), thue_morse(64, "1", "0")]
    runs = spark.createDataFrame([(k, " ".join(w) + " " + " ".join(f"e{k}{i}" for i in range(6))) for k, w in enumerate(words)], "doc_id long, text string")
    brute = Counter()
    seqs = [r["text"].split() for r in runs.orderBy("doc_id").collect()]
    for s in seqs:
        brute.update(tuple(s[k : k + 35]) for k in range(len(s) - 34))
    for r in substring_dedup.repeats(runs).collect():
        s, gone = seqs[r["doc_id"]], set()
        for k in range(len(s) - 34):
            if brute[tuple(s[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        assert r["n_removed"] == len(gone)


def test_near_copies_of_one_text(spark):
    """A large group of near copies, some of them far from its centre: components as by brute force, and few pairs read."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{k}y{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    asked = []
    original = jaccard_join.written

    def watched(df, what, *more):
        out = original(df, what, *more)
        if what == "asked":
            asked.append(out.count())
        return out

    jaccard_join.written = watched
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs).collect()}
    finally:
        jaccard_join.written = original
    assert got == dict(enumerate(label)) and len(set(label)) > 10
    assert sum(asked) < 12 * len(rows)  # of 12,720 pairs


def test_components(spark, monkeypatch):
    from lagweave.llm import components as module

    rng = random.Random(4)
    edges = [(rng.randrange(-99, 99), rng.randrange(-99, 99)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(40)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    for bound in (200_000, 9):
        monkeypatch.setattr(module, "EDGES", bound)
        assert {r["vertex"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def test_ranges_cover_all_hashes():
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64) * 2)
    for n in (1, 3, 64, 5000):
        full, at = exchange.parted(h, n, 64)
        assert (exchange.range_of(h, n, 64) == np.repeat(full, np.diff(at))).all() and full.max(initial=0) < n
        for k, s in zip(full, exchange.placed(h, full.tolist(), n, 64)):
            assert (exchange.range_of(h[s], n, 64) == k).all()
    assert exchange.parted(h[:0], 4, 64)[1].tolist() == [0]


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    from lagweave.llm import runtime

    monkeypatch.setattr(runtime, "shared_dir", lambda _: str(tmp_path))
    df = spark.range(5)
    with pytest.raises(RuntimeError), runtime.scratch(spark):
        runtime.written(df, "gone")
        runtime.written(df, "kept-here")
        raise RuntimeError
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["kept"]


def test_top_k_reads_few_of_clustered_vectors():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 64))
    for noise, most in ((0.15, 0.2), (0.5, 1.0)):
        v = np.floor(64 * (centres[rng.integers(0, 60, 4000)] + noise * rng.normal(size=(4000, 64))) / 8).astype(np.float64)
        v[100:110] = v[99]  # ties
        lists, share = topk.Lists(rng.permutation(4000), v), []
        for k in range(0, 4000, 100):
            at, score, scored = lists.top(lists.vectors[k], lists.ids[k], 20)
            every = lists.vectors @ lists.vectors[k]
            every[k] = -np.inf
            want = np.lexsort([lists.ids, -every])[:20]
            assert at.tolist() == want.tolist() and (score == every[want]).all()
            share.append(scored / 3999)
        assert np.mean(share) < most


# -- HTML against a naive walk over html.parser


class Walk(HTMLParser):
    """Words of all text outside elements that are never shown."""

    HIDDEN = {"script", "style", "title", "head", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            self.open.remove(tag)

    def handle_data(self, data):
        if not self.open:
            self.words += data.split()


def test_html_words_against_a_plain_parser():
    rng = random.Random(5)
    inline, block = ["b", "i", "em", "span", "a"], ["p", "div", "section", "blockquote", "h2"]

    def piece(depth):
        kind = rng.randrange(7)
        words = " ".join(f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 6)))
        if depth == 0 or kind == 0:
            return f" {words} &amp; "
        if kind == 1:
            t = rng.choice(inline)
            return f" <{t} title='x y'>{piece(depth - 1)}</{t}> "
        if kind == 2:
            return f"<ul>{''.join(f'<li> {words} {piece(depth - 1)} ' for _ in range(3))}</ul>"
        if kind == 3:
            return "<table>" + "".join("<tr>" + "".join(f"<td> {words} <td>{rng.randrange(99)}" for _ in range(2)) for _ in range(2)) + "</table>"
        if kind == 4:
            return f"<script>var no{rng.randrange(9)} = 1;</script><style>p {{}}</style><!-- no -->"
        t = rng.choice(block)
        return f"<{t}>{piece(depth - 1)}{piece(depth - 1)}</{t}>"

    for _ in range(150):
        page = f"<html><head><title>no</title></head><body>{piece(4)}{piece(4)}</body></html>"
        walk = Walk()
        walk.feed(page)
        walk.close()
        shown = [w for w in html_layout.text_of(page)[0].split() if w not in ("-", "*")]
        assert Counter(shown) == Counter(walk.words)


def test_tables_however_deep():
    page = "<table><tr><td>a<td>b</table>"
    for _ in range(60):
        page = f"<table><tr><td>{page}<td>z</table>"
    shown, _, tables = html_layout.text_of(page)
    assert tables == 61 and "a  b" in shown and shown.split().count("z") == 60 and "\n" not in shown


def test_spans_are_the_standards():
    cell = html_layout.Node("td", {"colspan": "0003", "rowspan": "0"})
    assert html_layout._span(cell, "colspan") == 3 and html_layout._span(cell, "rowspan") == 65534
    for raw, want in (("", 1), ("x", 1), ("0", 1), ("2x", 2), ("1001", 1000), ("9" * 5000, 1000), ("-4", 1), ("+7", 7)):
        assert html_layout._span(html_layout.Node("td", {"colspan": raw}), "colspan") == want


def test_an_empty_table_of_pages(spark):
    assert html_layout.rendered(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


# -- models against plain Python


def test_language_model_against_plain_python(spark):
    """Margins and decoding of a fitted model, gram by gram, in plain Python; a repeated row changes nothing."""
    rng = random.Random(6)
    words = {"en": ["the", "and", "house", "water"], "de": ["der", "und", "haus", "wasser"], "es": ["el", "casa", "agua", "señor"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for k, lang in enumerate(list(words) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, 20)
    again = language_id.fit(docs.unionAll(spark.createDataFrame([rows[0]] * 500, docs.schema)), 20)
    assert model.languages == again.languages == ["de", "en", "es"] and np.allclose(model.weights, again.weights, atol=1e-4)

    def mix(x):
        m = 2**64 - 1
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    def plain(t):
        total, n_grams = np.zeros(model.weights.shape[1]), 0
        for w in t.lower().encode().split():
            padded = b" " + w + b" "
            for n in language_id.GRAMS:
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if g.strip() and b" " not in g[1:-1]:
                        total += model.weights[mix(int.from_bytes(g, "big") + (n << 40)) >> (64 - language_id.BITS)]
                        n_grams += 1
        margin = total / max(np.sqrt(n_grams), 1) + model.bias
        loss = [(np.log1p(np.exp(-margin * c)) * t_).sum() for c, t_ in zip(model.code, model.trust)]
        share = np.exp(-model.code.shape[1] * (np.array(loss) - min(loss)) / 2)
        return model.languages[int(np.argmin(loss))], (share / share.sum()).max()

    got = {r["doc_id"]: r for r in language_id.identified(docs, 20).collect()}
    right = 0
    for d, t, lang in rows:
        name, share = plain(t)
        assert got[d]["lang_pred"] == name and got[d]["score"] == pytest.approx(share, abs=1e-4)
        right += got[d]["held_out"] and name == lang
    assert right >= 0.9 * sum(r["held_out"] for r in got.values())


def test_languages_beyond_the_sample(spark):
    rows = [(k, f"word{k} text{k}", f"l{k}") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(language_id.fit(docs, 5, rows=3).languages) == 3


def test_toxicity_model(spark):
    """The score is a logistic function of the words a text holds, recomputed one by one; repeated rows change nothing; held-out labels are met."""
    rng = random.Random(7)
    clean, bad = [f"calm{k}" for k in range(60)], ["idiot", "stupid", "moron", "scum", "trash"]
    rows = [(k, " ".join(rng.choice(clean + bad * (8 if k % 4 == 0 else 0)) for _ in range(25))) for k in range(600)]
    labels = spark.createDataFrame([(k, 0, int(k % 4 == 0)) for k in range(600)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(docs, labels).collect()}
    twice = {r["doc_id"]: r["score"] for r in toxicity.scored(docs.unionAll(spark.createDataFrame([rows[1]] * 300, docs.schema)), labels).collect()}
    assert all(twice[d] == pytest.approx(r["score"], abs=1e-3) for d, r in got.items())
    held = [(d, r) for d, r in got.items() if r["held_out"]]
    assert {d for d, _ in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == int(d % 4 == 0) for d, r in held]) > 0.95
    model = toxicity.fit(docs, labels).classifier
    for d, t in rows[:40]:
        for chunk in text.chunks(pa.array([t])):
            code, offsets = toxicity.profile(chunk)
            assert model.score(code, offsets)[0] == pytest.approx(got[d]["score"], abs=1e-6)


# -- tables as they come


def test_stages_take_any_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, columns of clashing names, an empty table: every stage has its result."""
    import corpus_pipeline

    rng = random.Random(8)
    prose = lambda: " ".join(f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{rng.randrange(40)}" for _ in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, batch int, range string, digest int"
    rows = [(k, t := prose(), "en" if k % 2 else "de", "s", len(t), 1, "r", 2) for k in range(40)]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (90, None, "en", "s", 0, 1, "r", 2), (91, "", "en", "s", 0, 1, "r", 2), (92, "w " * 30_000, "en", "s", 60_000, 1, "r", 2)]
    spark.createDataFrame([("1", rows[5][1]), (None, None)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(str(tmp_path / f"{len(table)}-{k}"))
            fresh = spark.read.parquet(str(tmp_path / f"{len(table)}-{k}"))
            if k < 4:
                assert fresh.columns == docs.columns and fresh.count() <= docs.count()
                docs = fresh
        assert (fresh.count() > 0) == bool(table)


def test_token_files_of_repeated_ids(spark, monkeypatch):
    """Many files, and one id (or none) that fills several: every row once, in ascending ids, starts without gaps."""
    monkeypatch.setattr(token_binary, "FILE_BYTES", 2000)
    rng = random.Random(10)
    rows = [(k % 50 if k % 3 else 7, " ".join(rng.choice(["a", "bb", "token", "xyz"]) for _ in range(rng.randrange(40)))) for k in range(400)] + [(None, "null id")] * 90
    got = token_binary.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), tokenizer_file()).collect()
    got.sort(key=lambda r: r["start"])
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert len(got) == len(rows) and ids == sorted(ids) and Counter(ids) == Counter(-1 if d is None else d for d, _ in rows)
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer_file()).encode
    want = Counter((d, zlib.crc32(np.array([*encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())) for d, t in rows)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
