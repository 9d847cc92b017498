"""Each operator against a brute-force version, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from seqlake.llm import decontamination as dc
from seqlake.llm import extraction as ex
from seqlake.llm import fingerprints as fp
from seqlake.llm import near_dedup as nd
from seqlake.llm import packing as pk
from seqlake.llm import quality as ql
from seqlake.llm import sharding as sh
from seqlake.llm import suffix_dedup as sd
from seqlake.llm import tokens as tk
from seqlake.llm import warc
from seqlake.llm.common import Scratch

#: Nulls in any column, empty and white texts, ties, repeated rows, a long text, and extra columns with clashing names.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, label string, split string, hilbert string, bucket string"
EXTRA = ("u", "l", "s", "h", "b")


def table(spark, rows):
    """(id, text[, lang, source]) rows as documents with extra columns."""
    full = [(i, t, *(rest or ("en", "src")), len(t or ""), *EXTRA) for i, t, *rest in ((r[0], r[1], *([tuple(r[2:])] if len(r) > 2 else [])) for r in rows)]
    full = [(r[0], r[1], *(r[2] if isinstance(r[2], tuple) else (r[2], r[3])), *r[(3 if isinstance(r[2], tuple) else 4):]) for r in full]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "délta", "x", "Ünder", "don't", "$$$", "12,5", "<|endoftext|>", "日本語", "éa"]
    prose = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 8, 60, 300]))) for _ in range(30)]
    prose += [prose[5] + "\n" + prose[6], "  two  blanks\t\ttabs\n\nlines ", "a" * 5000, "word " * 2000, "." * 50, "İstanbul ſtraße", "\x01 cut \x01"]
    rows = [(i, t) for i, t in enumerate(prose)]
    return rows + [(100, None), (101, ""), (102, " \n\t "), (103, prose[4]), (103, prose[4]), (104, prose[4]), (None, prose[7])]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward())


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, [(1, "x")]).limit(0)


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# ---------------------------------------------------------------- op1 and op2


def test_token_counts(docs, empty):
    path = tk.default_path(tk.VOCABULARY)
    plain = tk.tokenizer(path)
    want = Counter((i, len((t or "").encode()), n := len(plain.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in awkward())
    assert Counter(rows_of(tk.token_counts(docs, path))) == want
    assert tk.token_counts(empty, path).count() == 0


def test_parts_join_to_text():
    for _, t in awkward():
        assert "".join(tk.split_safely(t or "")) == (t or "")


def test_packing(docs, empty):
    path = pk.default_path(pk.VOCABULARY)
    plain = pk.tokenizer(path)
    want = Counter()
    for i, t in awkward():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start : start + 64]
            want[i, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    got = pk.pack(docs, path, capacity=64).toPandas()
    key = got[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(object).where(got[["doc_id", "piece", "start", "length", "ids_crc32"]].notna(), None)
    assert Counter(map(tuple, key.itertuples(index=False))) == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 64
    assert pk.pack(empty, path).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_a_packing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice((10, 64, 4096))
    lengths = Counter(min(capacity, max(1, int(rnd.lognormvariate(rnd.choice((1, 3, 6)), 1)))) for _ in range(rnd.choice((1, 5, 50, 1500))))
    runs, bins = pk.plan_bins(dict(lengths), capacity)
    seen, fill = Counter(), {}
    for length, rank, n, first, offset in runs:
        for i in range(n):
            seen[length, rank + i] += 1
            fill.setdefault(first + i, []).append((offset, length))
    assert seen == Counter({(n, i): 1 for n, c in lengths.items() for i in range(c)})
    assert sorted(fill) == list(range(bins))
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    if sum(lengths.values()) > 40:
        assert bins <= 1.25 * math.ceil(sum(n * c for n, c in lengths.items()) / capacity) + 1


# ------------------------------------------------------------------------ op3


def removed(texts, threshold):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[x : x + threshold] for r in raws for x in range(len(r) - threshold + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), dtype=bool)
        for x in range(len(r) - threshold + 1):
            if seen[r[x : x + threshold]] > 1:
                gone[x : x + threshold] = True
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((gone & ~np.concatenate([[False], gone])[:-1]).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("threshold", (40, 97))
def test_suffix_dedup(spark, docs, empty, threshold):
    rnd = random.Random(threshold)
    base = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.choice((10, 200, 600)))) for _ in range(12)]
    texts = [*base, base[3], base[3], None, "", "a" * 500, "ab" * 300, "b" + "a" * 100]
    for _ in range(25):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = rnd.randrange(len(a)), rnd.randrange(len(b))
        texts.append(b[:j] + a[i : i + rnd.choice((threshold - 2, threshold, threshold + 30, 300))] + b[j : j + 200])
    rows = list(enumerate(texts)) + [(None, base[4]), (0, base[0])]
    want = Counter((i, *x) for (i, _), x in zip(rows, removed([t for _, t in rows], threshold)))
    assert Counter(rows_of(sd.removal_digest(table(spark, rows), threshold))) == want
    assert sd.removal_digest(empty, threshold).count() == 0
    kept = sd.without_repeats(docs, 400)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_first_copies_stay(spark):
    """With keep_first a window goes unless it is its first occurrence, by id and place."""
    threshold, rnd = 40, random.Random(31)
    base = ["".join(rnd.choice("abcd \n") for _ in range(300)) for _ in range(5)]
    texts = [*base, base[1], "x" * 200, "y" + "x" * 150, base[2][50:200] + base[3][10:90], base[0][:120] + "-" + base[0][100:260], None, "", "ab" * 90]
    for _ in range(20):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = rnd.randrange(200), rnd.randrange(200)
        texts.append(a[i : i + rnd.choice((39, 40, 41, 90))] + b[j : j + rnd.choice((20, 60, 100))])
    seen, want = set(), []
    for t in texts:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for x in range(len(raw) - threshold + 1):
            if raw[x : x + threshold] in seen:
                gone[x : x + threshold] = True
            seen.add(raw[x : x + threshold])
        want.append(None if t is None else np.frombuffer(raw, np.uint8)[~gone].tobytes().decode())
    got = {r.doc_id: r.text for r in sd.without_repeats(table(spark, list(enumerate(texts))), threshold, keep_first=True).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_long_texts_are_read_in_segments(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(1)
    text = "".join(rnd.choice("abcd") for _ in range(9000))
    monkeypatch.setattr(sd, "_POS_BITS", 11)
    covered = np.zeros(9000 - 40 + 1, dtype=int)
    for _, at, data, offsets in sd._segments(pa.array([text]), 40):
        _, first, last, *_ = sd.anchored_runs(data, offsets, 40)
        for a, b in zip(first + at, last + at):
            covered[a : b + 1] += 1
    assert (covered == 1).all()


def test_parts_of_long_texts(spark, monkeypatch):
    """Runs are split in parts of a text; the result is that of whole texts."""
    rnd = random.Random(12)
    base = "".join(rnd.choice("abcde \n") for _ in range(60_000))
    texts = [base, base[1000:30_000] + base[20_000:59_000], "x" + base[40_000:41_000] * 3, base[:90]]
    want = Counter((i, *x) for (i, _), x in zip(enumerate(texts), removed(texts, 97)))
    for bits in (22, 9):
        monkeypatch.setattr(sd, "_PART_BITS", bits)
        assert Counter(rows_of(sd.removal_digest(table(spark, list(enumerate(texts))), 97))) == want


# ------------------------------------------------------------------------ op4


@pytest.fixture(scope="module")
def trees():
    return ex.trained()


def test_held_out_pages(trees):
    right = total = 0
    for page, kept in ex.training_pages(80, seed=999):
        got = ex.main_text(page, trees).split("\n")
        right += sum((Counter(got) & Counter(kept)).values())
        total += max(len(got), len(kept))
    assert right / total > 0.97


def test_blocks_and_references(trees):
    body = "".join(f"<p>Sentence number {i} of the article, with some words in it.</p>" for i in range(6))
    page = f"<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>one<b>two</b>\n &lt;three&gt;<br>four.</p>{body}</article><footer>&copy; me</footer>"
    text = ex.main_text(page, trees)
    assert text.startswith("A & B\nonetwo <three> four.\nSentence number 0") and "Home" not in text and "©" not in text


def test_pages_of_all_sorts(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>", "x"), (3, "u", "plain words only", "x"), (4, "u", "<div>" * 3000 + "deep" + "</div>" * 10, "x"), (5, "u", "<script>never closed", "x"), (5, "u", "<script>never closed", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ex.extract(df).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert ex.extract(df.limit(0)).count() == 0


ARTICLE = "<p>The river rose quickly in the night, and by the morning, three streets were under water.</p><p>Repairs will take months, officials said.</p>"
HEAD = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
FOOT = "<footer>&copy; 2020 site</footer></body></html>"


@pytest.mark.parametrize(
    "middle",
    [
        f"<div><button>Menu</div><article>{ARTICLE}</article>", f"<div><svg><path d='x'></div><article>{ARTICLE}</article>", f"<article><svg>{ARTICLE}</article>",
        f"<article><video src=x>{ARTICLE}</article>", f"<noscript><article>{ARTICLE}</article>", f"<svg><title>icon</svg><article>{ARTICLE}</article>",
        f"{'<div>' * 2000}{ARTICLE}{'</div>' * 2000}", f"<article class='blog-post advert-free'>{ARTICLE}</article>", f"<article><button>Share <b>this</b></button>{ARTICLE}<button>Print</button></article>",
        f"<title>late<article>{ARTICLE}</article>", f"<article><p></p><select><option>a{ARTICLE}</article>", f"<article><template><p>no</p></template>{ARTICLE}</article>",
    ],
)
def test_odd_markup_keeps_the_article(trees, middle):
    want = ["The river rose quickly in the night, and by the morning, three streets were under water.", "Repairs will take months, officials said."]
    got = ex.main_text(HEAD + middle + FOOT, trees).split("\n")
    assert [x for x in got if x in want] == want and len(got) <= 3


def test_stray_quotes_are_no_text(trees):
    page = f'{HEAD}<article><p title="5"" x>One and two are numbers, as everybody knows.</p>{ARTICLE}</article>{FOOT}'
    assert ex.main_text(page, trees).startswith("One and two are numbers") and '"' not in ex.main_text(page, trees)


def test_digits_of_the_whole_block():
    text = "a word " * 60 + "12345 " * 70 + "end"
    blocks, features = ex.blocks_of(ex.parse(f"<html><body><p>{text}</p></body></html>"))
    at = [b.text for b in blocks].index(text)
    assert features[at, 6] == pytest.approx(sum(map(str.isdigit, text)) / len(text)) and features[at, 6] > 0.3


# ------------------------------------------------------------------------ op5


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def groups(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, len(sets[i]), low.get(find(i)) if sets[i] else k, k is not None and k == (low.get(find(i)) if sets[i] else k)) for i, (k, _) in enumerate(rows)]


def near_copies(seed, n_base=6, n_each=30, length=60):
    rnd = random.Random(seed)
    rows = []
    for _ in range(n_base):
        base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(500)) for _ in range(length)]
        for _ in range(n_each):
            own = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2, 3, 4))):
                own[rnd.randrange(length)] = f"edit{rnd.randrange(40)}"
            rows.append(" ".join(own))
    rnd.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, seed):
    rows = near_copies(seed)
    assert sorted(rows_of(nd.near_duplicates(table(spark, rows)))) == sorted(groups(rows))


def test_near_duplicates_awkward(docs, empty):
    got, want = (Counter(map(repr, x)) for x in (rows_of(nd.near_duplicates(docs)), groups(awkward())))
    assert got == want
    assert nd.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("n", (1, 7, 90, 700))
def test_super_minhash_estimates(n):
    rng = np.random.default_rng(n)
    both, errors = n * 2 // 3, []
    for _ in range(25):
        u = rng.integers(0, 2**63, size=2 * n - both, dtype=np.uint64)
        s = nd.super_minhash(np.repeat([0, 1], n), np.concatenate([u[:n], u[n - both :]]), 2)
        errors.append((s[0] == s[1]).mean() - both / (2 * n - both))
    assert abs(np.mean(errors)) < 0.05


def test_components_of_chains(spark):
    chain = [(i + 1, i) for i in range(60)] + [(100 + i, 100) for i in range(1, 40)] + [(300, 299), (299, 301)]
    df = spark.createDataFrame(random.Random(1).sample(chain, len(chain)), "a long, b long").repartition(7)
    got = dict(rows_of(nd.components(df, Scratch(spark, "t"), "c")))
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 40)}, 300: 299, 301: 299}


# ------------------------------------------------------------------------ op6


def test_lcs():
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y and y >= 0 else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rnd = random.Random(2)
    for _ in range(60):
        a, b = ([rnd.randrange(-1 if k else 0, 6) for _ in range(rnd.randrange(1, 30))] for k in range(2))
        assert dc.lcs(a, b) == plain(a, b)


def test_decontamination(spark, docs, empty):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: " ".join(rnd.choice(("the", "of", "and", word())) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(rnd.choice((16, 30, 58)))).capitalize() + ".") for i in range(12)]
    rows, want = [], set()
    for i in range(120):
        rows.append((i, prose(rnd.choice((5, 40, 300)))))
    for k, (item, text) in enumerate(items):
        rows.append((200 + k, f"{prose(50)} {text} {prose(37)}"))
        want.add((200 + k, item))
        words = text.split()
        for _ in range(len(words) // 8):  # a paraphrase: some words replaced, one inserted
            words[rnd.randrange(len(words))] = word()
        words.insert(len(words) // 2, word())
        rows.append((300 + k, f"{prose(20)} {' '.join(words)} {prose(60)}"))
        want.add((300 + k, item))
        rows.append((400 + k, f"{prose(30)} {' '.join(text.split()[:5])} {prose(30)}"))  # a phrase alone is no leak
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "the")], "item_id long, text string")
    got = dc.contaminated(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert dc.contaminated(docs, bench).count() == 0 and dc.contaminated(empty, bench).count() == 0
    assert dc.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items(spark):
    """Items of any number of words are found where a text is the item; longer ones also inside a text."""
    rows = [(0, "What is the capital of Kazakhstan"), (1, "Paris, France"), (2, "we went to Paris France today"), (3, "so what is the capital of Kazakhstan? ask"), (4, "the of and"), (5, "the of and the")]
    rows += [(10 + i, "the of and " * 20) for i in range(60)]
    bench = spark.createDataFrame([(1, "what is the capital of kazakhstan"), (2, "Paris France"), (3, "the of and"), (4, " ".join(["the", "of", "and"] * 8))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(table(spark, rows), bench).collect()}
    assert got == {(0, 1), (3, 1), (1, 2), (4, 3), *((10 + i, 4) for i in range(60))}


def test_items_that_leak_often(spark):
    """The more often an item leaks, verbatim or paraphrased, the more common its words are."""
    rnd = random.Random(19)
    word = lambda: "".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: " ".join(rnd.choice(("the", "of", "and", word())) for _ in range(n))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((9, 24, 45))]
    rows, want = [(i, prose(60)) for i in range(600)], set()
    for item, text in items:
        for k in range(200):
            words = text.split()
            if k % 2:
                words[rnd.randrange(len(words))] = word()
                words.insert(len(words) // 3, word())
            rows.append((1000 * (item + 1) + k, f"{prose(rnd.randrange(60))} {' '.join(words)} {prose(30)}"))
            want.add((1000 * (item + 1) + k, item))
    bench = spark.createDataFrame([*items, (50, "the"), (51, " ".join(["the", "of", "and"] * 9))], "item_id long, text string")
    got = dc.contaminated(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id < 50} == want
    assert not any(r.item_id == 50 for r in got)


def test_verbatim_excerpts(spark):
    """A long run of an item is a leak wherever in the item it lies; a phrase isn't."""
    rnd = random.Random(23)
    word = lambda: "".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randrange(4, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = [word() for _ in range(59)]
    parts = [item[:45], item[:13], item[20:34], item[-13:], item[:12], item[30:42], item[5:10]]
    rows = [(i, f"{prose(40)} {' '.join(p)} {prose(25)}") for i, p in enumerate(parts)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, prose(59))], "item_id long, text string")
    got = dc.contaminated(table(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.lcs) for r in got} == {(0, 7, 45), (1, 7, 13), (2, 7, 14), (3, 7, 13)}


def test_latent_space_grows():
    """Items weigh alike in the matrix at every size, and have as many directions each in every block."""
    ranks, rows = zip(*(dc.space(n, n * 10_000) for n in (200, 400, dc.ITEMS_PER_BLOCK)))
    assert all(r >= 0.55 * n for r, n in zip(ranks, (200, 400, dc.ITEMS_PER_BLOCK)))
    assert [r / (n * 10_000) for r, n in zip(rows, (200, 400, dc.ITEMS_PER_BLOCK))] == pytest.approx([dc.ITEM_SHARE] * 3)


def test_long_texts_and_ties(spark):
    """An item deep in a long text, repeated rows and repeated items."""
    rnd = random.Random(29)
    word = lambda: "".join(rnd.choice("aeioubcdfglmnprst") for _ in range(rnd.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(30)
    long = f"{prose(60_000)} {item} {prose(20_000)}"
    rows = [(1, long), (1, long), (2, prose(50_000)), (3, None), (4, item), (4, item)]
    bench = spark.createDataFrame([(7, item), (7, item), (8, item)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in dc.contaminated(table(spark, rows), bench).collect())
    assert got == {(1, 7): 4, (1, 8): 2, (4, 7): 4, (4, 8): 2}


def test_very_long_pages(trees):
    page = f"{HEAD}<article>{ARTICLE * 4000}</article>{FOOT}"
    got = ex.main_text(page, trees).split("\n")
    assert len(got) == 8000 and len(set(got)) == 2


# ------------------------------------------------------------------------ op7


def test_kneser_ney_is_a_distribution(spark):
    """Probabilities of all symbols after a context sum to one, less what the floor gives to bytes that never occur."""
    import pyarrow as pa

    from seqlake.llm.common import text_bytes

    texts = ["the cat sat on the mat", "the rat sat on the hat and the cat", "a cat and a rat"] * 3
    grams, _, _ = ql.symbol_grams(*text_bytes(pa.array([" ".join(texts)])))
    counts = Counter(grams.tolist())
    own = spark.createDataFrame([(g, n, n) for g, n in counts.items()], "gram long, trusted long, decent long")
    scratch = Scratch(spark, "kn")
    alpha, gamma = ql.kneser_ney(own, scratch)
    some = sorted(counts)[:6]
    every = [(g >> 8 << 8) | b for g in some for b in range(256)]
    asked = spark.createDataFrame([(g,) for g in set(every)], "gram long")
    p = {r.gram: r.trusted for r in ql.probabilities(asked, alpha, gamma, scratch).collect()}
    for g in some:
        assert sum(p[(g >> 8 << 8) | b] for b in range(256)) == pytest.approx(1.0, abs=1e-6)
    assert all(p[g] > p[(g >> 8 << 8) | 200] for g in some)


def corpus(seed=3, n=240):
    rnd = random.Random(seed)
    parts = "the and ing er on re in ed ha th es at".split()
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.choice((1, 2, 3))))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(30, 120))]
        toxic, junk = i % 6 == 1, i % 6 == 2
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(("zqxidiot", "vlumpscum", "krwzmoron"))
        if junk:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or i % 3:
            labels.append((i, int(not junk), int(toxic)))
    return rows, labels


def test_quality(spark, docs, empty):
    rows, labels = corpus()
    known = spark.createDataFrame([*labels, (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in ql.judged(table(spark, rows), known).collect()}
    assert all(kept[i] == (i % 6 not in (1, 2)) for i in kept), [i for i in kept if kept[i] != (i % 6 not in (1, 2))]
    got = ql.judged(docs, known).collect()
    assert len(got) == len(awkward()) and all(r.kept for r in got if r.doc_id in (100, 101, 102))
    assert ql.judged(empty, known).count() == 0
    assert all(r.kept for r in ql.judged(docs, known.limit(0)).collect())


def plain_symbols(text):
    """Symbols of a text one by one."""
    out, before = [], None
    for word in re.findall(rb"[^ \t-\r]+", (text or "").encode()):
        word = re.sub(rb"[0-9]", b"0", word)
        out += [ql.AGAIN] if word == before else list(word)
        out.append(ql.END)
        before = word
    return out


def plain_kneser_ney(texts):
    """Probability of a symbol after a context, by the textbook's recursion on dictionaries."""
    n = ql.ORDER
    full = Counter()
    for t in texts:
        padded = [ql.START] * (n - 1) + plain_symbols(t)
        full.update(tuple(padded[i : i + n]) for i in range(len(padded) - n + 1))
    counts = {n: full}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[-k:] for g in {g[-k - 1 :] for g in full})
    found, follows = {}, {}
    for k, own in counts.items():
        n1, n2, n3, n4 = (max(1, sum(c == i for c in own.values())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        found[k] = [min(max(d, 0.1), i - 0.05) for i, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), 1)]
        follows[k] = {}
        for g, c in own.items():
            follows[k].setdefault(g[:-1], []).append(c)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else ql.FLOOR
        after = follows[k].get(gram[:-1])
        if not after:
            return lower
        d = found[k]
        c = counts[k].get(gram, 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / sum(after) + sum(d[min(x, 3) - 1] for x in after) / sum(after) * lower

    return p


def test_scores_are_the_plain_models(spark):
    """Scores by shards, which have the same text in several blocks, equal a model on dictionaries."""
    rows, labels = corpus(n=40)
    rows += [(900, "the  the\nthe and 12 and 345 é\t"), (901, None), (902, " \n"), (903, "x")]
    df, known = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in ql.scores(df, known, Scratch(spark, "s")).collect()}
    texts = dict(rows)
    trusted, decent = (plain_kneser_ney([texts[i] for i in texts if got[i].label in want]) for want in ((2,), (1, 2)))
    assert len({r.label for r in got.values()}) == 4
    for i, text in texts.items():
        own = plain_symbols(text)
        padded = [ql.START] * (ql.ORDER - 1) + own
        one, two = ([math.log(m(tuple(padded[k : k + ql.ORDER]))) for k in range(len(own))] for m in (trusted, decent))
        assert got[i].symbols == len(own) and got[i].nll == pytest.approx(-sum(one), rel=1e-4, abs=1e-4)
        words = np.split(np.array(two) - np.array(one), np.flatnonzero(np.array(own) == ql.END)[:-1] + 1) if own else []
        assert got[i].peak == pytest.approx(max((w.sum() for w in words), default=0.0), abs=1e-3)


def test_word_order_counts(spark):
    rnd = random.Random(8)
    phrases = ["one two three four", "red green blue", "over the hills and far away", "once upon a time"]
    rows = [(i, " ".join(rnd.choice(phrases) for _ in range(40))) for i in range(80)]
    words = " ".join(phrases).split()
    rows += [(100 + i, " ".join(rnd.choice(words) for _ in range(140))) for i in range(10)]
    known = spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in ql.judged(table(spark, rows), known).collect()}
    assert not any(got[100 + i] for i in range(10)) and sum(got[i] for i in range(80)) >= 78


# ------------------------------------------------------------------------ op8


def test_fingerprints(docs, empty):
    rows = sorted(awkward(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want = Counter()
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        small = max(len(shingles(x)) for x in (t, edited, after)) <= fp.K // 2
        exact = (round(likeness(shingles(t), shingles(edited)), 9), round(likeness(shingles(t), shingles(after)), 9)) if small else None
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), exact] += 1
    got = fp.fingerprints(docs).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(dict_sum(want))
    exact = {(i, n, h): e for (i, n, h, e) in want if e}
    for r in got:
        key = (r.doc_id, r.n_chars, r.edited_sha256)
        if key in exact:
            assert (round(r.near_edited, 9), round(r.near_next, 9)) == exact[key]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fp.fingerprints(empty).count() == 0


def dict_sum(counted):
    out = Counter()
    for (i, n, h, _), k in counted.items():
        out[i, n, h] += k
    return out


def test_sketches_merge_and_estimate():
    a = " ".join(f"w{i}" for i in range(4000)).encode()
    b = " ".join(f"w{i}" for i in range(2000, 6000)).encode()
    x, y, whole = fp.sketches([a, b, a + b" " + b])
    assert abs(fp.resemblance(x, y) - 1 / 3) < 0.1 and abs(fp.containment(x, y) - 0.5) < 0.15
    assert abs(fp.distinct_shingles(x) / 3996 - 1) < 0.25
    joined = fp.merge(x, y)
    assert len(np.intersect1d(joined, whole)) > 0.95 * fp.K  # but for the seam
    assert (fp.from_text(fp.to_text(x)) == x).all()


# ------------------------------------------------------------------------ op9


def test_curve_is_continuous():
    place = sorted((sh.curve_position([x, y, z], 3), (x, y, z)) for x in range(8) for y in range(8) for z in range(8))
    assert [p for p, _ in place] == list(range(512))
    assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(place, place[1:]))


def test_sharding(spark, docs, empty):
    got = sh.hilbert_shards(docs, 40).toPandas()
    assert Counter((None if pd.isna(i) else int(i), s, c) for i, s, c in zip(got.doc_id, got["size"], got.text_crc32)) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in awkward()
    )
    sizes = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert sizes.max() - sizes.min() <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in got.groupby("shard"))
    assert sh.hilbert_shards(empty).count() == 0
    hot = table(spark, [(i, "same text") for i in range(3000)] + [(5000 + i, "x" * i) for i in range(100)])
    sizes = sh.hilbert_shards(hot).groupBy("shard").count().toPandas()["count"]
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1


def test_shards_prune_files(spark, tmp_path):
    rnd = random.Random(4)
    sources = [f"https://site{i:03}.example/" for i in range(60)]
    rows = [(i, "x" * rnd.choice((5, 60, 900, 9000)), rnd.choice(("de", "en", "en", "fr", None)), rnd.choice(sources)) for i in range(3000)]
    sh.write_shards(table(spark, rows), str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s")).toPandas()
    assert len(got) == 3000 and got["shard"].nunique() == 40
    for column, some in (("source", sources[7]), ("lang", "de"), ("size", 16 + 9000)):
        own = got.dropna(subset=[column]).groupby("shard")[column].agg(["min", "max"])
        assert ((own["min"] <= some) & (own["max"] >= some)).sum() <= 24, column


# ----------------------------------------------------------------------- op10


def plain_root(placed, fanout, levels):
    """The root of an archive, level by level on lists."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    nodes = {p: digest(f"leaf:{o}:{n}:{hashlib.sha256(raw).hexdigest()}") for p, o, n, raw in placed}
    for _ in range(levels):
        above = {}
        for p in sorted(nodes):
            above.setdefault(p // fanout, []).append(f"{p}={nodes[p]}")
        nodes = {p: digest(",".join(own)) for p, own in above.items()}
    return digest(",".join(nodes[p] for p in sorted(nodes)))


def test_roots_are_the_plain_trees(spark):
    placed = Scratch(spark, "w").keep(warc.records(pages(spark), 40), "placed")
    by_archive = {}
    for r in placed.collect():
        by_archive.setdefault(r.archive, []).append((r.position, r.offset, r.length, bytes(r.record)))
    for levels in (warc.LEVELS, 1):  # one level is too few, so that several top nodes remain
        found = warc.audit(placed, placed, Scratch(spark, "w"), 4, levels).collect()
        assert {r.state for r in found} == {"intact"} and len(found) == 92
        assert {(r.archive, r.root) for r in found} == {(a, plain_root(own, 4, levels)) for a, own in by_archive.items()}


def test_audit_of_shifted_and_extra_records(spark):
    from pyspark.sql import functions as F

    placed = Scratch(spark, "w").keep(warc.records(pages(spark), 1000), "placed")
    more = placed.filter("position = 5").withColumn("position", F.col("position") + 500)
    other = placed.withColumn("offset", F.when(F.col("position") == 9, F.col("offset") + 1).otherwise(F.col("offset"))).unionByName(more)
    state = {(r.position, r.state) for r in warc.audit(placed, other, Scratch(spark, "w")).collect() if r.state != "intact"}
    assert state == {(9, "altered"), (505, "extra")}
    state = {(r.position, r.state) for r in warc.audit(other, placed, Scratch(spark, "w")).collect() if r.state != "intact"}
    assert state == {(9, "altered"), (505, "missing")}


def test_audit_query(spark, sf_dir):
    """The whole query against the records made one by one."""
    got = {r.page_id: r for r in warc.op10_merkle_audit(spark, sf_dir).collect()}
    want = {r.page_id: bytes(r.record) for r in warc.records(spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()}
    assert set(got) == set(want)
    for i, raw in want.items():
        other = raw[:-5] + b"\x00\r\n\r\n" if zlib.crc32(raw) % warc.DAMAGE_ONE_IN == 0 else raw
        assert (got[i].record_sha256, got[i].replica_sha256) == (hashlib.sha256(raw).hexdigest(), hashlib.sha256(other).hexdigest())
        assert (got[i].state == "intact") == (raw == other)




def pages(spark, n=90):
    rows = [(i, f"http://x/{i}", f"<p>page {i} é</p>" * (i % 7 + 1), "t") for i in range(n)] + [(None, None, None, "t"), (1, "http://x/1", "<p>page 1 é</p>" * 2, "t")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, hash string")


def test_archives_hold_whole_records(spark, tmp_path):
    placed = warc.records(pages(spark), 30)
    warc.write_archives(placed, str(tmp_path / "a"))
    back = warc.read_archives(spark, str(tmp_path / "a"))
    assert back.count() == 92
    for archive in {r.archive for r in back.select("archive").distinct().collect()}:
        raw = warc.archive_bytes(back, archive)
        for r in back.filter(f"archive = {archive}").collect():
            own = raw[r.offset : r.offset + r.length]
            assert own == bytes(r.record) and own.startswith(b"WARC/1.1\r\n")
            head, _, body = own.partition(b"\r\n\r\n")
            assert int(re.search(rb"Content-Length: (\d+)", head)[1]) == len(body) - 4


def test_audit_finds_every_fault(spark):
    from pyspark.sql import functions as F

    placed = Scratch(spark, "w").keep(warc.records(pages(spark), 30), "placed")
    bad = {(r.archive, r.position) for r in placed.filter("page_id IN (3, 50)").collect()}
    gone = {(r.archive, r.position) for r in placed.filter("page_id = 70").collect()}
    other = placed.filter("page_id IS NULL OR page_id <> 70").withColumn("record", F.when(F.col("page_id").isin(3, 50), F.reverse(F.hex("record")).cast("binary")).otherwise(F.col("record")))
    found = warc.audit(placed, other, Scratch(spark, "w")).collect()
    assert {(r.archive, r.position) for r in found if r.state == "altered"} == bad
    assert {(r.archive, r.position) for r in found if r.state == "missing"} == gone
    assert len(found) == 92 and all((r.root != r.replica_root) == (r.archive in {a for a, _ in bad | gone}) for r in found)
    assert warc.audit(placed.limit(0), placed.limit(0), Scratch(spark, "w")).count() == 0
