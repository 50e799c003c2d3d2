"""Near duplicates, repeats, pieces, personal data, leaks and pages against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyweir.llm import decontaminate, htmltext, ngram_join, pieces, pii, repeats
from tallyweir.llm.queries import piece_model
from tests.llm.conftest import SCHEMA, SF, documents, passage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    sets = {d: shingles(t) for d, t in rows}
    having = collections.defaultdict(list)
    for d in sorted(sets):
        for s in sets[d]:
            having[s].append(d)
    shared = collections.Counter((a, b) for ds in having.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_copies(rng, groups=12):
    rows = []
    for _ in range(groups):
        base = passage(rng, rng.choice([3, 5, 6, 30, 90, 200])).split()
        for _ in range(rng.randint(1, 30)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = passage(rng, 1)
            if rng.random() < 0.3:
                w += passage(rng, rng.randint(1, len(w))).split()
            rows.append((len(rows), (" " if rng.random() < 0.9 else " \t\n").join(w).title() if rng.random() < 0.2 else " ".join(w)))
    line = passage(rng, 40)
    rows += [(len(rows) + i, passage(rng, 60) + " " + line + " " + passage(rng, 60)) for i in range(60)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_near_copies(spark, seed):
    rows = near_copies(random.Random(seed))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == components(rows)


def test_components_with_frequent_shingles_and_small_tiles(spark, monkeypatch):
    rows = near_copies(random.Random(3), 6)
    monkeypatch.setattr(ngram_join, "FREQUENT_ROWS", 3)
    monkeypatch.setattr(ngram_join, "TILE_HUBS", 7)
    monkeypatch.setattr(ngram_join, "TILE_OTHERS", 20)
    monkeypatch.setattr(ngram_join, "TOKENS_PER_BUCKET", 500)
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == components(rows)


def test_components_of_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == components([(r.doc_id, r.text) for r in docs.collect()])


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 420)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.sig: r.label for r in ngram_join.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


def removed(rows, length):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def repeat_rows(rng):
    rows = near_copies(rng, 4)
    n = len(rows)
    rows += [(n, "ab" * 400), (n + 1, "x" * 1000), (n + 2, "x" * 150 + "y" * 150 + "x" * 120), (n + 3, None), (n + 4, "é" * 80 + "\0" * 300), (n + 5, "\0" * 120)]
    return rows


@pytest.mark.parametrize(("length", "many"), [(100, 4096), (100, 2), (32, 3), (24, 4096)])
def test_removed_bytes(spark, monkeypatch, length, many):
    monkeypatch.setattr(repeats, "MANY_CONTENTS", many)
    monkeypatch.setattr(repeats, "WINDOWS_HELD", 50 if many == 2 else 5000)
    rows = repeat_rows(random.Random(length + many))
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs, length=length).collect()}
    assert got == removed(rows, length)


def test_removed_bytes_over_piece_borders(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", (1 << 16) + 1000)
    rng = random.Random(6)
    long = passage(rng, 30_000)
    rows = [(0, long), (1, passage(rng, 100) + long[50_000:150_000]), (2, long[777:140_000] + passage(rng, 300))]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == removed(rows, 100)


def test_removed_bytes_of_documents(spark):
    docs = documents(spark)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == removed([(r.doc_id, r.text) for r in docs.collect()], 100)


def test_maximal_repeats():
    rng = random.Random(7)
    for _ in range(600):
        alphabet = rng.choice([b"ab", b"abc", b"a", b"ab\0\xff"])
        texts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 4))]
        least = rng.randint(1, 4)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        found = collections.defaultdict(list)
        for d, t in enumerate(texts):
            for i in range(len(t)):
                for n in range(least, len(t) - i + 1):
                    found[t[i : i + n]].append((d, i))
        want = set()
        for s, places in found.items():
            before = {texts[d][i - 1 : i] if i else d for d, i in places}
            after = {texts[d][i + len(s) : i + len(s) + 1] or d for d, i in places}
            if len(places) > 1 and len(before) > 1 and len(after) > 1:
                want.add((len(s), tuple(sorted(int(offsets[d]) + i for d, i in places))))
        got = [(n, tuple(sorted(o.tolist()))) for n, o in repeats.maximal_repeats(np.frombuffer(b"".join(texts), np.uint8), offsets, least)]
        assert len(got) == len(set(got)) and set(got) == want


def test_contexts_of_a_run_are_compared_as_bytes():
    rng = random.Random(16)
    texts = [bytes(rng.choice(b"ab") for _ in range(3)) for _ in range(400)]
    n = len(texts)
    flat, place = np.frombuffer(b"".join(texts), np.uint8), 3 * np.arange(n)
    zero = np.zeros(n, np.uint64)  # all hashes collide
    stand, gone = repeats.repeated_contexts(zero, zero, np.arange(n), np.zeros(n, np.uint32), np.zeros(n, np.int32), np.full(n, 3, np.int32), place, flat)
    first = {t: texts.index(t) for t in texts}
    assert sorted(stand) == sorted(first.values()) and sorted([*stand, *gone]) == list(range(n))
    assert [len(x) for x in repeats.repeated_contexts(*(zero[:0],) * 7, flat[:0])] == [0, 0]


def test_scratch_tables_are_deleted(spark, tmp_path):
    from tallyweir.llm import common

    with common.scratch():
        gone, stays, bucketed = common.cut(spark.range(3), "a"), common.cut(spark.range(4), "b", keep=True), common.cut(spark.range(5), "c", "id")
        assert gone.count() == 3 and bucketed.join(bucketed, "id").count() == 5
        paths = [p for _, p, _ in common._WRITTEN[-3:]]
    exists = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert [exists(p) for p in paths] == [False, True, False] and stays.count() == 4


def test_slots_are_sparks(spark):
    keys = [0, 1, -1, 12345678901234, -(1 << 63), (1 << 63) - 1]
    got = [r.s for r in spark.createDataFrame([(k,) for k in keys], "k long").selectExpr("pmod(xxhash64(k), 97) s").collect()]
    assert repeats.spark_slot(np.array(keys, np.int64), 97).tolist() == got


def test_pieces_equal_the_library(spark):
    table = pieces.ChunkTable(piece_model(), entries=50)
    assert table.split_ok
    rng = random.Random(9)
    texts = [r.text for r in documents(spark).collect()] + ["", " ", "  a  b  ", "\n\n", "▁a ▁", "a\0b", "x" * 3000, " " * 77, "é" * 300, "<s> <unk>", "<0x0A> ﬁ ① Å 😀"]
    texts += ["".join(rng.choice(" ab\n\t é日😀. ​<s>́﻿\x01▁") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    for t in texts:
        ids = table.sp.encode(t)
        assert table.encode_decode(t) == (",".join(map(str, ids)), len(ids), table.sp.decode(ids))
    assert len(table) <= 50


def base_by_pattern(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_base_spans():
    rng = random.Random(10)
    for _ in range(5000):
        t = "".join(rng.choice("a1 9.@+-()0-2 45..@") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == base_by_pattern(t)
    assert pii.base_spans("9" * 200_000 + ".1.2.3 " + "." * 50) == []
    assert len(pii.base_spans("1.1.1.1 " * 20_000)) == 20_000


def test_added_spans_touch_no_base_span():
    weights = pii.fit(pii.generated(random.Random(1), 300))
    rng = random.Random(4)
    for _ in range(200):
        t = " ".join(rng.choice(["1.2.3.4", "a@b.cd", "+1 555 555 1234", "(640) 555-0953", "x [at] y [dot] com", "4539148803436467", "12", "word"]) for _ in range(12))
        base, every = pii.all_spans(t, weights)
        for a, _, b in set(every) - set(base):
            assert not any(p < b and a < q for p, _, q in base)


def test_field_adds_spans_and_keeps_the_base():
    weights = pii.fit(pii.generated(random.Random(1), 600))
    right = total = wrong = 0
    for text, spans in pii.generated(random.Random(2), 300):
        base, every = pii.all_spans(text, weights)
        assert set(base) <= set(every)
        right, total, wrong = right + len(set(every) & set(spans)), total + len(spans), wrong + len(set(every) - set(spans))
    assert right > 0.95 * total and wrong < 0.05 * total


def test_dynamic_programme_against_all_cuts():
    rng = random.Random(11)
    for _ in range(200):
        n = rng.randint(1, 6)
        segments = [(s, e) for s in range(n) for e in range(s + 1, n + 1) if rng.random() < 0.6]
        scores = np.array([[rng.uniform(-2, 2) for _ in range(4)] for _ in segments]).reshape(-1, 4)

        def value(at):
            if at == n:
                return 0.0
            return max([value(at + 1), *(max(scores[i]) + value(e) for i, (s, e) in enumerate(segments) if s == at)])

        chosen = pii.best(n, segments, scores)
        assert abs(sum(scores[segments.index((s, e))][k] for s, e, k in chosen) - value(0)) < 1e-9


def test_long_regions_lose_nothing_at_their_parts(monkeypatch):
    weights = pii.fit(pii.generated(random.Random(1), 600))
    for gap in range(4):
        text = "a " * gap + " ".join(f"name{'x' * (i % 3)} (212) 555-{i:04d}" for i in range(600))
        assert len([x for a, b in pii.regions(text) for x in pii.lattice(text, pii.atoms(text, a, b))]) > 5
        _, found = pii.all_spans(text, weights)
        with monkeypatch.context() as m:
            m.setattr(pii, "MAX_REGION", 10**9)
            assert pii.all_spans(text, weights)[1] == found
        starts = {text.index(f"(212) 555-{i:04d}") for i in range(600)}
        assert starts <= {a for a, _, _ in found}


def test_masking(spark):
    assert pii.masked("a b@c.de +1 555 555 0000!", pii.base_spans("a b@c.de +1 555 555 0000!")) == "a [EMAIL] [PHONE]!"


def smith_waterman(x, y):
    h = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a == b else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment():
    rng = random.Random(12)
    items = [np.array([rng.randrange(8, 80, 8) for _ in range(rng.randint(1, 20))], np.uint64) for _ in range(200)]
    windows = [np.array([rng.randrange(8, 80, 8) for _ in range(rng.randint(1, 50))], np.uint64) for _ in range(200)]
    assert decontaminate.align(items, windows)[0].tolist() == [smith_waterman(x.tolist(), y.tolist()) for x, y in zip(items, windows)]


def test_copied_and_edited_passages_are_found(spark):
    rng = random.Random(13)
    items = [(i, passage(rng, rng.randint(20, 60))) for i in range(20)]
    rows, want = [], set()
    for d in range(120):
        text = passage(rng, rng.randint(50, 300))
        if d % 3 == 0:
            i = rng.randrange(20)
            w = items[i][1].split()
            for k in range(0, len(w), 6):  # every sixth word replaced
                w[k] = passage(rng, 1)
            text += " " + " ".join(w).upper() + " " + passage(rng, 40)
            want.add((d, i))
        rows.append((d, text, None, None, None))
    got = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want


def test_a_common_part_of_an_item_is_found(spark):
    rng = random.Random(14)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n))
    shared, rest = words(24), words(36)
    texts = [f"{words(40)} {shared} {rest if d < 3 else ''} {words(20)}" if d < 23 else words(60) for d in range(400)]
    rows = [(d, t, None, None, None) for d, t in enumerate(texts)]
    items = [(0, f"{shared} {rest}"), (1, words(5)), (2, "one two three")]
    got = decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, 0) for d in range(23)}


def test_leaks_by_row_and_id_types(spark):
    rng = random.Random(21)
    one, two = passage(rng, 30), passage(rng, 40)
    texts = [(1, f"{one} {passage(rng, 20)} {two}"), (1, f"{one} {passage(rng, 20)} {two}"), (None, f"{passage(rng, 9)} {one}"), (None, f"{passage(rng, 9)} {two} {two}"), (2, passage(rng, 90)), (3, None)]
    texts[1] = texts[0]
    rows = spark.createDataFrame([(k, t, None, None, None) for k, t in texts], SCHEMA).repartition(2)
    for kind, ids in (("int", [7, 8]), ("long", [7, 8]), ("smallint", [7, 8]), ("string", ["a", "b"]), ("double", [0.5, 1.5])):
        items = spark.createDataFrame([(ids[0], one), (ids[0], one), (ids[0], passage(rng, 30)), (ids[1], two), (None, None)], f"item_id {kind}, text string")
        for block_bytes in (1 << 20, 100):
            df = decontaminate.leaks(rows, items, block_bytes=block_bytes)
            assert df.schema["item_id"].dataType == items.schema["item_id"].dataType
            got = sorted(((r.doc_id or 0, r.item_id, r.score) for r in df.collect()), key=str)
            assert got == sorted([(1, ids[0], 1.0), (1, ids[1], 1.0)] * 2 + [(0, ids[0], 1.0), (0, ids[1], 1.0)], key=str)
    # of two equal places the first
    ends = [r.end_word for r in decontaminate.leaks(rows, items).where("doc_id is null and item_id = 1.5").collect()]
    assert ends == [48]


def test_leaks_recall_against_all_pairs(spark):
    """Every document against every item by whole alignment: what reaches the threshold there is found through seeds."""
    rng = random.Random(22)
    items = [(i, passage(rng, rng.randint(12, 60))) for i in range(15)]
    rows = []
    for d in range(150):
        text = passage(rng, rng.randint(20, 120)).split()
        if d % 2:
            w = items[rng.randrange(15)][1].split()
            share = rng.choice([0, 0.1, 0.2, 0.3])
            w = [x for x in w if rng.random() > share / 2]
            w = [passage(rng, 1) if rng.random() < share else x for x in w]
            w = w[: rng.randint(len(w) // 2, len(w))]
            at = rng.randint(0, len(text))
            text[at:at] = w
        rows.append((d, " ".join(text), None, None, None))
    want = set()
    for i, t in items:
        x = decontaminate.words_of(pa.array([t]))[0]
        ys = [decontaminate.words_of(pa.array([r[1]]))[0] for r in rows]
        scores, _ = decontaminate.align([x] * len(ys), ys)
        want |= {(d, i) for d, s in enumerate(scores.tolist()) if s >= decontaminate.THRESHOLD * 2 * len(x) and s >= min(decontaminate.LEAST_SCORE, 2 * len(x))}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got <= want and len(want) > 50
    assert len(got) >= 0.9 * len(want), (len(got), len(want))


def naive_page(html):
    from html import unescape

    inner = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<[^>]*>?", lambda m: "\n" if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    got = htmltext.extract(pages).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == naive_page(html[r.page_id]) and r.n_chars == len(r.text)


def test_page_markup():
    page = (
        '<html><head><title>t</title><script>a("</p>")</script></head><body><header><h1>Site</h1></header><div class="cookie-notice">We use</div><main><article><header><h1>T &amp; x</h1></header>'
        '<p>One<br>two <b>b</b>&nbsp;c<div>d <span class="ad">buy</span></div><!-- <p>no</p> --><ul><li>1<li>2</ul><table><tr><td>a<td>b</table><form>f</form><section id="comments"><article>c1</article></section></article>'
        "<aside>s</aside></main><footer>f</footer><p>cut <b"
    )
    assert htmltext.main_text(page, "h", ()) == "T & x\n\nOne two b c\n\nd\n\n1\n\n2\n\na\n\nb"
    assert htmltext.main_text("", "h", ()) == "" and htmltext.main_text("plain  text", "", ()) == "plain text"


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><meta charset=x><article><p>One</p></article>", "One"), ("<head><link rel=x>Two<p>three", "Two\n\nthree"), ("<head><style>a</style></head><body>One</body>", "One"),
    ("<body><nav><button>Menu</nav><article><p>One</p></article>", "One"), ("<body><button>Menu<article><p>One</p></article><button>Up</button>", "One"), ("<body><select><option>a<option>b<p>One", "One"),
    ("<body><ul><li><video src=x>none</ul><p>One</p>", "One"), ("<p>One <button><div>Menu</div></button>two", "One two"), ("<p>One <svg><title>s</title><text>t</text></svg>two<svg/> three", "One two three"),
    ("<p>One<object><object>a<p>b</object><p>c</object> two", "One two"), ("<p>One <template><article>x</article></template>two", "One two"), ("<p>One<script>a<button></script> two<textarea>b", "One two"),
])
def test_elements_without_an_end(page, text):
    assert htmltext.main_text(page, "h", ()) == text


def template_pages(spark):
    rows = [(i, f"http://{'big' if i % 3 else 'small'}.example.com/{i}", f"<body><div><p>Shop now at our site</p><p>Every page has this</p></div><div><p>Own text number {i}</p></div></body>") for i in range(60)]
    rows += [(None, None, None), (60, "http://big.example.com/60", ""), (1, rows[1][1], rows[1][2])]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_site_template_goes_both_ways(spark):
    pages = template_pages(spark)
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    assert got[7] == "Own text number 7" and got[None] == "" and got[60] == ""
    assert {r.page_id: r.text for r in htmltext.extract(pages, broadcast_most=0).collect()} == got
    assert htmltext.extract(pages).count() == 63
    few = htmltext.extract(pages.where("page_id < 9")).collect()
    assert all("Every page has this" in r.text for r in few)
    assert htmltext.extract(pages.limit(0)).collect() == []


def test_copied_articles_are_no_template(spark):
    box = "<div><p>Read this first</p><ul><li>a<li>b</ul></div>"
    bodies = {
        "div": "<article><h1>T</h1><div><p>One text.</p><ul><li>x<li>y</ul><table><tr><td>z</table></div></article>", "plain": "<p>One text.</p><section>Two</section>",
        "wrapped": "<div><main><div><article><p>One text.</p><dl><dt>x<dd>y</dl></article></div></main></div><aside>{}</aside>",
    }
    want = {"div": "T\n\nOne text.\n\nx\n\ny\n\nz", "plain": "One text.\n\nTwo", "wrapped": "One text.\n\nx\n\ny"}
    rows = [(f"{k} {i}", f"http://{k}.example.com/{i}", f"<body><div>Top of the site</div>{b.format(i)}</body>") for k, b in bodies.items() for i in range(12)]
    # other pages of the hosts, which show the template
    rows += [(f"other {k} {i}", f"http://{k}.example.com/o{i}", f"<body><div>Top of the site</div>{f'<p>Own {i}</p>{box}' if k == 'plain' else f'<article><p>Own {i}</p>{box}</article>'}</body>") for k in bodies for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    for most in (htmltext.BROADCAST_MOST, 0):
        got = {r.page_id: r.text for r in htmltext.extract(pages, broadcast_most=most).collect()}
        assert {got[f"{k} {i}"] for k in bodies for i in range(12)} == set(want.values()) and all(got[f"{k} {i}"] == want[k] for k in bodies for i in range(12))
        assert all(got[f"other {k} {i}"] == f"Own {i}" for k in bodies for i in range(20))


def test_the_template_alone_gives_the_text(spark):
    """Without markup rules, and without taking articles: what recurrence deletes is nearly all that is no main text."""
    pages = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet")
    whole = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    alone = {r.page_id: r.text for r in htmltext.extract(pages, markup=False).collect()}
    body = {r.page_id: htmltext.main_text(r.html, "", (), markup=False) for r in pages.collect()}
    right = sum(alone[i] == t for i, t in whole.items())
    assert right > 0.85 * len(whole) and not any(body[i] == t for i, t in whole.items())
    chars = lambda texts: sum(map(len, texts.values()))
    assert chars(body) - chars(alone) > 0.85 * (chars(body) - chars(whole))


def test_places_of_little_text_go_and_bearing_ones_stay(spark):
    rng = random.Random(23)
    page = lambda i, n: f"<body><div class='x1'><ul><li>{passage(rng, 2)}<li>{passage(rng, 1)}</ul></div><div class='x2'><section><p>{passage(rng, n)}</p><div class='n'><p>{passage(rng, 8)}</p></div></section></div><div id='b{i}'>{passage(rng, 3)}</div></body>"
    rows = [(i, f"http://h.example.com/{i}", page(i, rng.choice([40, 80, 160]))) for i in range(6)]
    rows += [(6, "http://h.example.com/6", rows[0][2]), (7, "http://two.example.com/1", rows[1][2]), (8, "http://two.example.com/2", rows[2][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.extract(pages).collect()}
    for i, _, html in rows:
        blocks = [" ".join(b.split()) for b in re.findall(r"<p>(.*?)</p>", html)]
        # a host of two pages has no template
        assert got[i].split("\n\n") == blocks if i < 7 else set(blocks) < set(got[i].split("\n\n"))


def test_long_pages_and_clashing_columns(spark):
    rng = random.Random(24)
    long = passage(rng, 150_000)
    html = f"<body><nav>{passage(rng, 20_000)}</nav><article><p>{long}</p>{'<div>' * 3000}deep{'</div>' * 3000}</article></body>"
    pages = spark.createDataFrame([(1, "http://a.example.com/", html), (1, "http://a.example.com/", html), (2, None, None), (None, "x", "<p>a")], "page_id int, url string, html string")
    want = sorted([(1, f"{long}\n\ndeep"), (1, f"{long}\n\ndeep"), (2, ""), (None, "a")], key=str)
    assert sorted(((r.page_id, r.text) for r in htmltext.extract(pages).collect()), key=str) == want
    from pyspark.sql import functions as F

    extra = pages.withColumns({c: F.lit("clash") for c in ("key", "text", "n_chars", "subtree", "subtrees", "host", "pages", "context", "of")})
    got = htmltext.extract(extra)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted(((r.page_id, r.text) for r in got.collect()), key=str) == want
    assert htmltext.extract(pages, broadcast_most=0).count() == 4
    assert htmltext.extract(pages.where("false")).collect() == []
