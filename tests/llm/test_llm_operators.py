"""The training-data operators against brute force, on a fixture with every odd case."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeloom.llm import arrays, automata, centres, chosenpath, common, decontaminate, html, mixing, pii, quality, queries, repeats, runindex, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key long, bucket long, sid long, stratum string, t string"


def fixture_rows():
    """Copies, near copies, shared passages, repeats in a text, nulls, empty and long texts, repeated rows and ids."""
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(40), say(120)
    texts = [None, "", " \n\t", "one two", "one two", "a " * 400, passage, base, base, say(6000)]
    for _ in range(30):
        words = base.split()
        for _ in range(rng.choice((1, 2, 3, 8))):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        texts.append(" ".join(words))
    texts += [f"{say(rng.randint(1, 60))} {passage}\n{say(rng.randint(0, 30))}" for _ in range(25)]
    texts += [say(rng.randint(1, 200)) for _ in range(20)]
    texts += [passage + " x\n" + passage + "\n" + passage]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(7, base), (7, base), (60, say(30) + " " + passage), (None, passage + " " + say(20)), (None, None)]
    return rows


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ("en", "de", None)[k % 3], ("a", "b", None, "a", "a")[k % 5], 0, 1, 2, 3, "s", "t") for k, (i, t) in enumerate(ROWS)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return -math.inf if i is None else i


def removed(rows, length, split, inner):
    """Per row the flags of covered items."""
    places = collections.defaultdict(set)
    for k, (i, t) in enumerate(rows):
        items = split((t or "").encode())
        for j in range(len(items) - length + 1):
            places[tuple(items[j : j + length])].add((order(i), k, j))
    first = {w: min(p[0] for p in at) for w, at in places.items()}
    out = []
    for k, (i, t) in enumerate(rows):
        items = split((t or "").encode())
        flags = [False] * len(items)
        seen = set()
        for j in range(len(items) - length + 1):
            w = tuple(items[j : j + length])
            if first[w] < order(i) or inner and w in seen:
                flags[j : j + length] = [True] * length
            seen.add(w)
        out.append((i, items, flags))
    return out


@pytest.mark.parametrize(("hot", "local"), [(512, 32), (3, 32), (512, 1)])
def test_substring_dedup(docs, monkeypatch, hot, local):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LOCAL", local)
    want = sorted((order(i), len(w), sum(f), hashlib.sha256(b" ".join(x for x, y in zip(w, f) if not y)).hexdigest()) for i, w, f in removed(ROWS, 13, lambda b: re.findall(rb"[^\x20\x09-\x0D]+", b), False))
    got = sorted((order(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in automata.substring_dedup(docs).collect())
    assert got == want


@pytest.mark.parametrize(("hot", "local"), [(512, 32), (3, 32), (512, 1)])
@pytest.mark.parametrize("window", [100, 20])
def test_byte_dedup(docs, monkeypatch, hot, local, window):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "LOCAL", local)
    want = sorted((order(i), len(b), sum(f), sum(y and not x for x, y in zip([False, *f], f)), hashlib.sha256(bytes(x for x, y in zip(b, f) if not y)).hexdigest()) for i, b, f in removed(ROWS, window, list, True))
    got = sorted((order(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.byte_dedup(docs, window).collect())
    assert got == want


def test_dedup_keeps_texts(docs):
    kept = {(r.doc_id, r.kept_sha256): r.kept_bytes for r in runindex.byte_dedup(docs, keep_text=True).collect()}
    assert all(hashlib.sha256(bytes(b)).hexdigest() == sha for (_, sha), b in kept.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=4, max_size=14), min_size=1, max_size=8), st.integers(2, 4))
def test_run_index_classes(texts, length):
    items = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array(list(map(len, texts)))
    starts = np.cumsum(sizes) - sizes
    windows = [t[j : j + length] for t in texts for j in range(len(t) - length + 1)]
    for found in (runindex.classes(items, starts, sizes, length, np.zeros(len(texts), np.uint64)), automata.classes(items, starts, sizes, length, np.zeros(len(texts), np.uint64))):
        assert len({*zip(windows, found.tolist())}) == len(set(windows)) == len(set(found.tolist()))


def test_grams_that_recur_alone_go_no_further(spark):
    """Texts share 60 bytes, too few for a window, and one pair shares 140: only anchors of the pair are sent on."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    chance, passage = word(60), word(140)
    texts = [word(100) + chance + word(100) + (passage if i in (3, 17) else "") + word(50) for i in range(30)]
    rows = spark.createDataFrame([(i, t, i, i % 4) for i, t in enumerate(texts)], "doc_id long, text string, row_key long, bucket int")
    found = repeats.Repeats(repeats.Bytes, 100, 32, runindex.classes).repeated_anchors(rows, 4).collect()
    keys = {k for r in found for k in repeats.unpack(r.blob, np.int64, np.uint64, np.uint8)[0].tolist()}
    assert keys == {3, 17}
    got = {r.doc_id: r.n_removed for r in runindex.byte_dedup(rows).collect()}
    assert got[17] == 140 and sum(got.values()) == 140


@pytest.mark.parametrize(("letters", "most"), [(b"a", 400), (b"ab", 90), (bytes(range(256)), 60)])
def test_suffix_order(letters, most):
    """By the whole suffix up to its end, then by place, with places in the keys and apart."""
    rng = random.Random(len(letters))
    parts = [bytes(rng.choices(letters, k=rng.randint(1, most))) for _ in range(30)]
    whole, sizes = b"".join(parts), np.array(list(map(len, parts)))
    text, ends = np.frombuffer(whole, np.uint8), np.repeat(np.cumsum(sizes), sizes)
    order = sorted(range(len(whole)), key=lambda i: (whole[i : ends[i]], i))
    assert runindex.suffix_order(text, ends).tolist() == runindex.order_of_many(text, ends).tolist() == order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=6), max_size=40), st.integers(1, 20), st.booleans())
def test_content_ids(texts, step, clash):
    """Equal stretches and no others have equal ids, also where hashes clash."""
    items = np.frombuffer("".join(texts).encode(), np.uint8)
    sizes = np.array(list(map(len, texts)), np.int64)
    was = repeats.range_hashes
    try:
        repeats.range_hashes = (lambda c, a, b: was(c, a, b) & np.uint64(1)) if clash else was
        ids = repeats.content_ids(items, np.cumsum(sizes) - sizes, sizes, step).tolist()
    finally:
        repeats.range_hashes = was
    assert len(set(zip(texts, ids))) == len(set(texts)) == len(set(ids))


def test_run_index_follows_runs():
    """Copies add runs only for their ends, and the matching statistics are those of the suffixes."""
    rng = random.Random(4)
    copies = lambda n: [bytes(text)] * n
    text = [rng.randrange(97, 101) for _ in range(3000)]

    def built(parts):
        sizes = np.array(list(map(len, parts)))
        return runindex.RunIndex(np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.cumsum(sizes), sizes))

    one, many = built(copies(1)), built(copies(40))
    assert many.nbytes < 1.2 * one.nbytes and not any(len(x) >= 40 * 3000 for x in vars(many).values() if isinstance(x, np.ndarray))
    parts = [b"banana", b"bananas", b"nan", b"ananas"]
    index, whole = built(parts), b"".join(parts)
    ends = np.repeat(np.cumsum([len(x) for x in parts]), [len(x) for x in parts])
    order = sorted(range(len(whole)), key=lambda i: (whole[i : ends[i]], i))
    above, common = index.matching(np.arange(len(whole)))
    for a, b in zip(order, order[1:]):
        x, y = whole[a : ends[a]], whole[b : ends[b]]
        assert above[b] == a and common[b] == next((i for i, (c, d) in enumerate(zip(x, y)) if c != d), min(len(x), len(y)))


def links(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t or "")
        sets.append(frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset())
    n, parent = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                n[a], n[b] = n[a] + 1, n[b] + 1
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(order(i), order(least.get(find(k)) if sets[k] else i), n[k]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("leaf", [256, 4])
def test_chosen_path_join(docs, monkeypatch, leaf):
    monkeypatch.setattr(chosenpath, "LEAF", leaf)
    got = sorted((order(r.doc_id), order(r.class_id), r.n_links) for r in chosenpath.near_duplicates(docs).collect())
    assert got == sorted(links(ROWS))


def dense_texts(n, words=120, most=4):
    """A group of near copies, texts of their own, and what lies far from the group's middle."""
    rng = random.Random(11)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    base, texts = [rng.choice(vocab) for _ in range(words)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most) if i % 20 else 9):
            w[rng.randrange(words)] = rng.choice(vocab)
        texts.append(" ".join(w))
    return texts + [" ".join(rng.choice(vocab) for _ in range(words)) for _ in range(n // 4)]


@pytest.mark.parametrize("block", [1 << 17, 1 << 12])
def test_dense_groups_are_exact(spark, monkeypatch, block):
    """Copies around a centre, whose nodes split: every link is counted once, in one block and in many."""
    monkeypatch.setattr(chosenpath, "LEAF", 64)
    monkeypatch.setattr(centres, "BLOCK", block)
    texts = dense_texts(500)
    sets, number = [], {}
    for t in texts:
        w = t.split()
        sets.append({number.setdefault(tuple(w[j : j + 5]), len(number)) for j in range(len(w) - 4)})
    met, size = np.zeros((len(sets), len(sets)), np.int64), np.array(list(map(len, sets)))
    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for at in holders.values():
        met[np.ix_(at, at)] += 1
    link = 5 * met >= 4 * (size[:, None] + size[None, :] - met)
    degree = link.sum(axis=1) - 1
    near = link
    while ((more := near.astype(int) @ near.astype(int) > 0) != near).any():
        near = more
    got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [(int(near[i].argmax()), int(degree[i])) for i in range(len(texts))]


def test_dense_groups_take_part_in_no_run(spark, monkeypatch):
    """Near copies meet by node in the run that looks for them, not again in each run and after each split."""
    monkeypatch.setattr(chosenpath, "LEAF", 64)
    seen, sized = [], chosenpath._sized

    def counted(nodes):
        out = sized(nodes)
        seen.append(out.count())
        return out

    monkeypatch.setattr(chosenpath, "_sized", counted)
    texts = dense_texts(500, most=2)
    got = chosenpath.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts) and sum(seen) <= 3 * len(texts), seen


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_that_nobody_asks_for_are_not_shuffled(spark):
    """Long texts, of which two are alike: those two are shuffled, the others stay where they are read."""
    rng = random.Random(13)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnop", k=8)) for _ in range(3000)) for _ in range(100)]
    texts.append(texts[0] + " one more")
    docs = chosenpath.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    before, limit = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.doc_id: (r.class_id, r.n_links) for r in chosenpath.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {i: (0, 1) if i in (0, 100) else (i, 0) for i in range(101)}
    assert 0 < sum(n for k, n in shuffled(spark).items() if k not in before) < sum(map(len, texts)) // 4


def test_large_nodes_without_a_dense_part_ask_for_no_text(spark):
    rng, asked = np.random.default_rng(3), []
    rows = [(i, 1 + i % 2, 300, rng.integers(0, 1 << 32, 64, np.uint32).tobytes()) for i in range(600)]
    wide = chosenpath.staged(spark.createDataFrame(rows, "sid long, node long, members long, sketch binary"))

    def sets_of(wanted, **_):
        asked.append(wanted.count())
        return wanted.selectExpr("*", "cast('' as binary) as set")

    assert centres.gather(wide, sets_of, chosenpath.sketch_of, 64, 4, 5) is None
    assert asked == [0]


@pytest.mark.parametrize("slices", [1 << 14, 2])
def test_asked_loses_no_row(spark, monkeypatch, slices):
    """A filter that is too full lets more through, but loses nothing."""
    monkeypatch.setattr(common, "MOST_SLICES", slices)
    rng = np.random.default_rng(9)
    every = [int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 40_000)] + [0, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(x, str(x)) for x in every], "k long, v string")
    wanted = set(every[:20_000:2] + every[-4:])
    got = [tuple(r) for r in common.asked(df, spark.createDataFrame([(x,) for x in [*wanted, 5, 5]], "k long")).collect()]
    assert wanted <= {k for k, _ in got} and all(v == str(k) for k, v in got) and len(got) == len({k for k, _ in got})
    assert len(got) - len(wanted) < (600 if slices > 2 else len(every))
    assert common.asked(df, spark.createDataFrame([], "k long")).collect() == []


@pytest.mark.parametrize("least", [0.25, 0.3])
def test_sketches_near_any_centre(least):
    rng = np.random.default_rng(5)
    centres_, rows = (rng.integers(0, 3, (n, 64), np.uint32) for n in (7, 600))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(600)), pa.array([x.tobytes() for x in rows])], ["sid", "sketch"])
    got = sorted((s, c) for b in centres._near_any(np.arange(7) * 10, centres_, least)([batch]) for s, c in zip(*(x.to_pylist() for x in b.columns)))
    assert got == [(i, 10 * j) for i in range(600) for j in range(7) if (rows[i] == centres_[j]).mean() >= least]


def test_centres_hold_sets_of_any_distance():
    """The bounds on u decide as the sets themselves do."""
    rng = random.Random(3)
    for _ in range(300):
        c = set(range(rng.randint(1, 40)))
        pair = [({x for x in c if rng.random() < 0.9} | {100 + rng.randrange(8) for _ in range(rng.randrange(4))}) for _ in range(2)]
        x, y = pair
        u = [5 * len(c - s) + 4 * len(s - c) for s in pair]
        shared = len((x ^ c) & (y ^ c))
        assert (sum(u) - 9 * shared <= len(c)) == (5 * len(x & y) >= 4 * len(x | y))


def test_clashing_names_survive(spark):
    rows = [(1, "a b c d e f", 7, 8, 9), (2, "a b c d e f", 7, 8, 9), (3, None, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key long, _row long, row_key long")
    assert sorted(map(tuple, chosenpath.keep_one(docs).collect())) == [rows[0], rows[2]]
    spans = spark.createDataFrame([(1, "mail a@b.org now", 7, 8, 9, 1, "s"), (2, None, 7, 8, 9, 1, None)], "doc_id long, text string, _key long, _row long, row_key long, step int, spans string")
    assert sorted(map(tuple, pii.sanitise(spans).collect())) == [(1, "mail [EMAIL] now", 7, 8, 9, 1, "s"), (2, None, 7, 8, 9, 1, None)]


def test_keep_one(docs):
    judged = links(ROWS)
    kept = collections.Counter(r.text for r in chosenpath.keep_one(docs).collect() if WORD.search(r.text or ""))
    assert sum(kept.values()) == len({c for (_, c, n) in judged if n}) + sum(1 for (i, t), (_, _, n) in zip(ROWS, judged) if not n and WORD.search(t or ""))


def test_runs_reach_recall():
    assert chosenpath.runs_for(0.8, 0.9999) <= 6 and chosenpath.runs_for(0.8, 0.9) == 1


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    seen = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
    covered = {j + d for j in range(len(w) - 2) if seen[tuple(w[j : j + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_features(docs):
    got = sorted((order(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.features(docs, "doc_id").collect())
    want = []
    for i, t in ROWS:
        c = base_counts(t)
        want.append((order(i), *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert got == sorted(want)


@pytest.mark.parametrize(("k", "n", "p"), [(0, 100, 0.01), (3, 400, 0.02), (90, 5000, 0.02), (40, 20000, 0.0033), (0, 1, 0.5)])
def test_binomial_tail_is_exact(spark, k, n, p):
    exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(k + 1))
    got = spark.sql(f"select {quality.binomial_tail('k', 'n', p)} from values ({k}L, {n}L) t(k, n)").first()[0]
    assert got == pytest.approx(exact, rel=1e-6)


def test_cutoffs_hold_the_risk(spark):
    """Good documents score low; bad ones high. The cutoff rejects the bad and at most alpha of the good."""
    rng = random.Random(1)
    rows = [(i, "en", 100, 500, rng.randrange(4) if i % 5 else 90, 0, 0, 0, 0, False) for i in range(9000)]
    scored = spark.createDataFrame(rows, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_marks long, base_failed boolean")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(9000)], "doc_id long, quality int")
    judged = quality.judge(scored, labels)
    assert judged.where("n_symbols = 90 and kept").count() == 0 and judged.where("n_symbols < 90 and not kept").count() <= 0.02 * 7200
    few = labels.where("doc_id < 50")
    assert quality.judge(scored, few).where("not kept").count() == 0  # too few labels certify nothing


def test_verdicts_are_those_of_plain_tests(spark):
    """Strata of their own levels, two of them pooled: cutoffs differ, good documents are rejected too, as exact binomial sums say."""
    rng = random.Random(21)
    rows = []
    for lang, n, symbols, capitals in (("en", 2600, 9, 0.15), ("de", 900, 24, 0.04), ("es", 130, 12, 0.1), (None, 110, 12, 0.1)):
        for _ in range(n):
            good = rng.random() < 0.9
            k = 40 if good and rng.random() < 0.003 else symbols if good and rng.random() < 0.02 else rng.randrange(4) if good else rng.randrange(50, 95)
            rows.append((len(rows), lang, 100, 500, k, 0, 0, int(500 * capitals * rng.random()) if good else 300, 0, rng.random() < 0.1, good))
    columns = ("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "base_failed")
    scored = spark.createDataFrame([r[:-1] for r in rows], "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_capitals long, n_marks long, base_failed boolean")
    labels = spark.createDataFrame([(r[0], int(r[-1])) for r in rows], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(scored, labels).collect()}

    alpha, delta, grids = 0.02, 0.05, {k: g for k, (_, g) in quality.RULES.items()}
    score = lambda r: (lambda d: {k: eval(e, {}, d) for k, (e, _) in quality.RULES.items()})(dict(zip(columns, r)))  # noqa: E731, S307
    held = [r for r in rows if not r[-2] and r[-1]]
    proposes = lambda r: r[0] % 1000003 * 7919 % 1000003 % 4 == 0
    strata = {r[1] for r in held}
    level = delta / (len(strata) + 1)
    pool = {x for x in strata if sum(r[1] == x and not proposes(r) for r in held) < math.log(level) / math.log(1 - alpha)}
    found = {}
    for group in [{x} for x in strata - pool] + [pool]:
        mine = [(proposes(r), score(r)) for r in held if r[1] in group]
        first, rest = [s for p, s in mine if p], [s for p, s in mine if not p]
        at = {k: next((i for i, c in enumerate(g) if sum(s[k] > c for s in first) <= len(first) * alpha / len(grids)), len(g)) for k, g in grids.items()}
        cut = lambda k, lax: grids[k][at[k] + lax] if at[k] + lax < len(grids[k]) else math.inf  # noqa: E731, B023
        for lax in range(6):
            n, k = len(rest), sum(any(s[r] > cut(r, lax) for r in grids) for s in rest)
            if k < n * alpha and sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) <= level:
                found |= {x: {r: cut(r, lax) for r in grids} for x in group}
                break
    want = {r[0]: not r[-2] and all(v <= found.get(r[1], {}).get(k, math.inf) for k, v in score(r).items()) for r in rows}
    assert got == want
    rejected = [r for r in rows if not r[-2] and not want[r[0]]]
    assert len({tuple(c.values()) for c in found.values()}) > 1 and pool == {"es", None}
    assert 0 < sum(r[-1] for r in rejected) <= 0.02 * len(held) and sum(not r[-1] for r in rejected) > 200


def test_small_strata_get_cutoffs(spark):
    """Some hundred labels a language, and a pool of smaller languages, certify what rejects junk; good documents stay."""
    good = [(lang, "".join(f"w{i}{j}{lang} " for j in range(60)) + "# " * (i % 3)) for lang, n in (("en", 900), ("es", 400), ("it", 180), (None, 180)) for i in range(n)]
    junk = [(lang, "".join(f"w{i}{j}{lang} # " for j in range(60))) for lang in ("en", "es", "it", None) for i in range(20)]
    rows = [(i, lang, text) for i, (lang, text) in enumerate(good + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < len(good))) for i in range(len(rows))], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == set(range(len(good)))


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "phone":
            return 9 <= len(d) <= 15
        return kind == "email" or 12 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if j % 2 else int(c) for j, c in enumerate(reversed(d))) % 10 == 0

    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "") if valid(kind, m.group()))


PII_TEXTS = [
    None, "", "x@y.zz", "mail a.b+c@d-e.co.uk_f@g.h now", "a@b.com.x@y.org a@@b.c @x.y", "𝄞é 1.2.3.4 1.2.3.4.5 256.1.1.1 001.02.3.255 00000000000000000300.1.1.1",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4111 1111  1111 1111", "+1 (555) 123-4567 +49.30.1234 5678 9 + 12 +1-", "5" * 3000, "+" * 50 + "1" * 12, "a." * 2000 + "@b.c", "0" * 16, "1 " * 4000,
]


def test_pii_base_spans(spark):
    rows = list(enumerate(PII_TEXTS)) + [(2, "x@y.zz")]
    got = sorted((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in pii.pii_report(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, base string, row_key int")).collect())
    want = []
    for i, t in rows:
        s = base_spans(t)
        n = collections.Counter(x[2] for x in s)
        want.append((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in s).encode()).hexdigest(), *(n[k] for k in PII)))
    assert got == sorted(want)


def test_pii_terms_disclose(spark):
    """A rare word beside one address in different texts tells of it; common words and single texts do not."""
    rows = [(i, f"the report {i}\nthe zebrafish wrote to kim@x.org of case {i}\nthe end") for i in range(4)] + [(9, "the okapi wrote to lee@x.org")] * 3 + [(100 + i, f"the cat of day {i} wrote") for i in range(200)]
    found = {r.doc_id: r.spans for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[0][1].index("zebrafish")
    assert f"term:{at}:{at + 9}" in found[0].split(",") and "term" not in found[9] and found[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), support=2).collect()}
    assert "[EMAIL]" in clean[0] and "zebrafish" not in clean[0] and clean[100] == rows[-200][1]


def test_pii_terms_of_values_met_once(spark):
    """Values that never recur: a word on another line of texts with addresses of one domain tells of it."""
    rows = [(i, f"the quokka of {i}\nthe mail went to p{i}@zoo.org today") for i in range(12)] + [(100 + i, f"the mail of {i} went to us today") for i in range(200)]
    found = {r.doc_id: r for r in pii.pii_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(r.n_term == (i < 12) for i, r in found.items()) and "term:4:10" in found[0].spans.split(",")


def test_pii_of_a_very_long_line(spark):
    """One line of 50,000 addresses, twice and once more with a word: spans and cleaned text are those of plain patterns."""
    line = " ".join(f"a{i}@b{i % 7}.org" + (f" 10.0.0.{i % 250}" if i % 3 == 0 else "") for i in range(50_000))
    docs = spark.createDataFrame([(1, line), (1, line), (2, line + " x"), (3, "hello a5@b5.org")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pii_report(docs).collect()}
    want = base_spans(line)
    assert got[1].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in want).encode()).hexdigest() and got[1].n_email == 50_000
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[1] == re.sub(r"10\.0\.0\.\d+", "[IP]", re.sub(r"a\d+@b\d\.org", "[EMAIL]", line)) and clean[3] == "hello [EMAIL]"


def test_pii_terms_by_brute_force(spark):
    """Random texts of few words and values: the terms are those that counts in plain Python disclose."""
    rng = random.Random(9)
    people = [f"p{i}@{d}.org" for i in range(5) for d in ("x", "y")] + ["9.9.9.1", "9.9.9.2", "+49 30 123 4567 8"]
    rows = []
    for i in range(160):
        words = [rng.choice("the of and to in".split()) for _ in range(6)]
        if rng.random() < 0.4:
            who = rng.choice(people)
            words += [who, "desk" + re.sub("[^a-z0-9]", "", who)[:4]] + (["mailto"] if "@" in who else []) + ([f"rare{rng.randrange(12)}"])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(500, rows[0][1]), (501, None)]
    spans = {i: base_spans(t) for i, t in rows}

    def entities(text):
        for a, _, kind, b in base_spans(text):
            value = text[a:b].lower()
            digits = re.sub("[^0-9]", "", value)
            yield True, (kind, "value", digits if kind in ("card", "phone") else value)
            wider = {"email": [("local", value.split("@")[0]), ("domain", value.split("@")[-1])], "ip": [("net", ".".join(value.split(".")[:3]))], "card": [("issuer", digits[:6])], "phone": [("prefix", digits[:-7])]}[kind]
            for part in [*wider, ("class", "")]:
                yield False, (kind, *part)

    texts = {t for i, t in rows if spans[i]}
    held = collections.defaultdict(set)
    for t in texts:
        for own, e in entities(t):
            held[own, e].add(t)
    n_term = collections.Counter(w for _, t in rows for w in set((t or "").split()))
    risky = collections.defaultdict(set)
    for (own, e), at in held.items():
        for word, both in collections.Counter(w for t in at for w in set(t.split())).items():
            need = 2 if own else 10
            pmi = math.log2(both * len(rows) / (len(at) * n_term[word]))
            if both >= need and len(at) >= need and pmi > 0 and pmi >= 0.9 * math.log2(len(rows) / len(at)):
                risky[e].add(word)
    want = {}
    for i, t in rows:
        bad = set().union(*(risky[e] for _, e in entities(t))) if spans[i] else set()
        places = [(m.start(), m.end()) for m in WORD.finditer(t or "") if m[0] in bad]
        want[i] = sorted((a, b) for a, b in places if not any(a < d and b > c for c, _, _, d in spans[i]))
    got = {r.doc_id: sorted((x["start"], x["end"]) for x in r.terms) for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(map(len, want.values())) > 30


def test_pii_recall_of_sanitised_text(spark):
    rows = list(enumerate(PII_TEXTS))
    clean = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(base_spans(r.text) for r in clean if r.doc_id in (2, 3, 7))


def test_token_shards_round_trip(docs, spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    folder = f"file://{tmp_path}/shards"
    tokens.write_shards(docs, folder, queries.vocabulary_path(), shard_tokens=500)
    got = sorted((r.start, order(r.doc_id), r.n_tokens, r.ids_crc32) for r in tokens.read_shards(spark, folder).collect())
    at, want, every = 0, [], []
    for i, t in sorted(((i, t or "") for i, t in ROWS), key=lambda x: (order(x[0]), x[1])):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        want.append((at, order(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        every += ids
        at += len(ids)
    assert got == want
    shards = spark.read.parquet(folder).orderBy("shard").collect()
    assert len(shards) > 4
    token = collections.Counter(every).most_common(3)[2][0]
    held = sorted((order(i), k) for i, t in ROWS for k, x in enumerate([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) if x == token)
    assert sorted((order(r.doc_id), r.place) for r in tokens.occurrences(spark, folder, token).collect()) == held and len(held) > 50
    assert tokens.occurrences(spark, folder, 49_000).count() == every.count(49_000)
    read = [tokens.WaveletMatrix.from_bytes(bytes(s.blob))[0] for s in shards]
    assert np.concatenate([m.ids() for m in read]).tolist() == every


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=300), st.integers(4, 6))
def test_wavelet_matrix(values, bits):
    built = tokens.WaveletMatrix.build(np.array(values, np.uint16), bits)
    matrix, ends = tokens.WaveletMatrix.from_bytes(built.to_bytes(np.array([len(values)])))
    assert matrix.ids().tolist() == values and ends.tolist() == [len(values)]
    for i, x in enumerate(values[:40]):
        assert matrix.access(i) == x and matrix.rank(x, i) == values[:i].count(x)
        assert matrix.select(x, values[:i].count(x)) == i
    assert matrix.count(13) == 0 and matrix.select(3, values.count(3)) == -1 and matrix.count(1 << 20) == 0


def test_word_encoder_equals_the_tokenizer(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "CACHED_WORDS", 150)
    rng = random.Random(5)
    odd = ["İstanbul", "e\u0301te\u0301", "ß", "ﬁn", "don't", "we'll've", "x<|endoftext|>y", "<|startoftext|>", "\u0300", "中文字", "😀👍🏽", "a\u00a0b", "\u2003", "1234", "$$$!?", "ǅ", "\x00", "\x1f", "Ω\u0345"]
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.5 else "".join(chr(rng.choice((97, 98, 233, 0x301, 0x4E00, 39, 48, 65))) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    tokenizer, words, got = Tokenizer.from_file(queries.vocabulary_path()), tokens.WordEncoder(queries.vocabulary_path()), []
    for _, buf, offsets in arrays.text_chunks(pa.array(texts), 400):
        ids, ends = words.encode(buf, offsets, 1)
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_wavelet_ranks_cross_blocks():
    values = np.random.default_rng(1).integers(0, 50, 20000).astype(np.uint16)
    matrix = tokens.WaveletMatrix.build(values, 6)
    for i in (0, 4095, 4096, 4097, 8192, 19999, 20000):
        assert matrix.rank(7, i) == int((values[:i] == 7).sum())


BENCH = [(1, "Alpha beta, GAMMA delta 5 zeta eta theta iota kappa lambda"), (2, "short one"), (2, "short one"), (3, None), (4, "..."), (5, "é beta " * 8)]


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_decontaminate(spark, most):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    texts = [None, "", "x alpha BETA gamma delta 5 zeta eta theta iota kappa y", "alpha beta gamma delta 5 zeta eta theta iota kappa lambda mu" * 2, "a Short-One b short", "é beta " * 20, "short", "É beta", "long " * 9000 + "short one"]
    rows = list(enumerate(texts)) + [(2, texts[2]), (2, texts[2])]
    windows = collections.defaultdict(set)
    for i, t in BENCH:
        w = words.findall(low(t))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(str(i))
    want = []
    for i, t in rows:
        w = words.findall(low(t))
        hit, items = set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    items |= windows[tuple(w[j : j + n])]
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, hits int")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench, most_bytes=most)
    assert sorted(tuple(r)[:6] for r in found.collect()) == sorted(want)
    kept = decontaminate.remove_leaks(docs, bench, action="documents", most_bytes=most)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want if not w[5])
    spans = {r.doc_id: r.text for r in decontaminate.remove_leaks(docs, bench, action="spans", most_bytes=most).collect()}
    assert spans[2] == "x  y" and spans[4] == "a  b short" and spans[0] is None


def test_mixing_places_every_row_once(docs):
    got = mixing.mix_sources(docs, {"a": 3.0, "b": 1.0, None: 1.0}, 4, "doc_id").collect()
    assert sorted(r.position for r in got) == list(range(len(ROWS)))
    assert collections.Counter((r.source, r.slot) for r in got).most_common(1)[0][1] <= 4
    assert sorted(order(r.doc_id) for r in got) == sorted(order(i) for i, _ in ROWS)


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(1, 60), st.floats(0.01, 5)), min_size=1))
def test_schedule_is_pfair(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    slots = {}
    for s, a, b, units, total, start, table in mixing.schedule(blocks, weights):
        for j in range(b - a):
            at = start + j // units * total + table[j % units]
            assert at not in slots
            slots[at] = s
            # Within a stretch, block j + 1 of a source stands in its window: less than one block from the target.
            assert j * total // units <= at - start < -(-(j + 1) * total // units)
    assert sorted(slots) == list(range(sum(blocks.values()))) and collections.Counter(slots.values()) == blocks


def test_weights_are_exact_or_refused():
    blocks = {"a": 2000, "b": 2000, "c": 2}
    plan = mixing.schedule(blocks, {"a": 0.1, "b": 0.3, "c": 0.0001})
    first = {s: (u, p) for s, _, _, u, p, at, _ in plan if at == 0}
    assert first["a"] == (1000, 4001) and first["b"] == (3000, 4001) and sum(b - a for s, a, b, *_ in plan) == 4002
    assert first.get("c", (1, 4001)) == (1, 4001)  # a source far below a thousandth keeps its weight
    for bad in (0, 0.0, -1, -0.5):
        with pytest.raises(ValueError, match="above zero"):
            mixing.schedule(blocks, {"a": bad, "b": 1})
    with pytest.raises(ValueError, match="shorter period"):
        mixing.schedule({"a": 10**9, "b": 10**9}, {"a": 1.0000000000001, "b": 1})


def test_mix_follows_target_weights(spark):
    """At every slot, while all sources last, each is less than one block from its target; ids and texts may be null."""
    docs = spark.createDataFrame([(i if i % 50 else None, "x" if i % 7 else None, ("a", "b", None)[i % 3], i) for i in range(3000)], "doc_id long, text string, source string, slot long")
    weights = {"a": 5, "b": 1.5, "gone": 9}
    got = mixing.mix_sources(docs, weights, 4, "doc_id", default=0.5).collect()
    assert sorted(r.position for r in got) == list(range(3000))
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i if i % 50 else None for i in range(3000))
    seen, share = collections.Counter(), {"a": 5 / 7, "b": 1.5 / 7, None: 0.5 / 7}
    for slot, source in sorted({(r.slot, r.source) for r in got}, key=lambda x: x[0]):
        assert all(abs(seen[s] - share[s] * slot) < 1 for s in share)
        seen[source] += 1
        if seen["a"] == 250:
            break


def test_html():
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>if (a<b) document.write("</p>")</script></head><body class=home>
    <header><p>Site, name, here</p></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav><div class="ad">Buy, buy, buy, now</div>
    <article><header><h1>Title &amp; more</h1></header><p>First <b>bold<br>text, with&nbsp;commas,
    and   spaces.<p class="share">Share this<p>Second &lt;b&gt; paragraph, fine.</p><form><input> name, mail, text</form><div id="comments"><p>I, too, like, it, very, much, indeed.</p></div><ul><li>one<li>two</ul></article>
    <aside><p>Related, stuff, and, so, on</p></aside><footer>&copy; x</footer><!-- <p>no, no</p> --></body></html>"""
    assert html.extract(page) == "Title & more\nFirst bold text, with commas, and spaces.\nSecond <b> paragraph, fine.\none\ntwo"
    assert html.extract(None) == html.extract("") == html.extract("<nav>a</nav>") == "" and html.extract("plain  text") == "plain text"
    assert html.extract("<p>a<p>b</div></p>") == "a\nb"
    long = "<body><article>" + "".join(f"<p>word{i}, and more text of some length here.</p>" for i in range(5000)) + "<p>open <a href='x>y"
    assert html.extract(long).count("\n") >= 4999


def test_html_keeps_all_of_a_nested_article():
    long = "Some words, and more words, of the text that is long enough to count, as it goes on. "
    wide = lambda inner: f"<body><div><p><a href=x>Home</a> <a href=y>News</a></p></div>{inner}<div><p><a href=z>All rights</a></p></div></body>"
    many = "".join(f"<p>{i} {long * 3}</p>" for i in range(20))
    lines = [f"{i} {(long * 3).strip()}" for i in range(20)]
    assert html.extract(wide(f"<article><h1>T</h1><p>short lead</p><div class=body>{many}</div></article>")) == "\n".join(["T", "short lead", *lines])
    assert html.extract(wide(f"<article><h1><a href=s>T</a></h1><section>{many}</section><section><h2>B</h2><p>brief</p></section><div><h3>More</h3><p><a href=q>other pages</a></p></div></article>")) == "\n".join(["T", *lines, "B", "brief"])
    assert html.extract(wide(f"<article><h1>T</h1><p>lead</p><blockquote>{many}</blockquote><p>end</p></article>")) == "\n".join(["T", "lead", *lines, "end"])
    assert html.extract(wide(f"<div><h1>T</h1><p>lead</p><blockquote>{many}</blockquote><p>end</p></div>")) == "\n".join(["T", "lead", *lines, "end"])


def test_html_keeps_the_odd_parts_of_an_article():
    """Sections, tables, items, boxes, a named paragraph and the head of an article stay; what is no article goes."""
    prose = "Some words, and more words, of the text that is long enough to count, as it goes on."
    page = lambda x: f"<html><body><header><h1>Site</h1></header><nav><a href=x>Home</a></nav>{x}<footer>foot</footer></body></html>"
    body = "".join(f"<p>{i} {prose} {prose}</p>" for i in range(4))
    lines = [f"{i} {prose} {prose}" for i in range(4)]
    cells = "".join(f"<tr><td>{i}, {prose}</td><td>{prose}</td></tr>" for i in range(8))
    for inner, want in (
        (f"<article><h1>T</h1><section><h2>A</h2>{body}</section><section><h2>B</h2><p>brief</p></section></article>", ["T", "A", *lines, "B", "brief"]),
        (f"<article><h1>T</h1><p>intro</p><table>{cells}</table><p>end</p></article>", ["T", "intro", *(x for i in range(8) for x in (f"{i}, {prose}", prose)), "end"]),
        (f"<article><h1>T</h1><p>intro</p><ul><li>one</li><li>{prose * 6}</li><li>three</li></ul></article>", ["T", "intro", "one", prose * 6, "three"]),
        (f"<article><h1>T</h1><div>lead</div><div>{prose}</div><div>{prose}</div><div>end</div></article>", ["T", "lead", prose, prose, "end"]),
        (f"<article><h1>T</h1><p id=social>{prose}</p><p class=share>Share this</p><p>end</p></article>", ["T", prose, "end"]),
        (f"<article><header class=article-header><h1>T</h1></header>{body}</article>", ["T", *lines]),
        (f"<div><div class=top><h1>T</h1></div><div class=body>{body}<p>end</p></div></div>", ["T", *lines, "end"]),
        (f"<article><h1>T</h1>{body}<div class=related><p>{prose}</p></div><section id=comments><p>{prose}</p></section></article>", ["T", *lines]),
    ):
        assert html.extract(page(inner)).split("\n") == want, inner[:60]


def test_url_links_are_resolved(spark):
    from urllib.parse import urljoin

    page = "http://h.net/a/b/c.html?q=1"
    targets = ["page2.html", "?id=3", "../x", "./y", "../../../z", "..", "d/./e/../f?g=../h", "/r/../s", "//o.net/p", "https://k.net/l", "t#u"]
    rows = [(page, f'<link rel=canonical href="{t}">') for t in targets] + [(page, f"<base href='/base/'><meta http-equiv=refresh content='0; url={t}'>") for t in targets]
    rows += [("http://m.net", '<link rel=canonical href="one"><link rel=canonical href="two"><meta http-equiv=refresh content="0;url=three"><meta http-equiv=refresh content="0;url=four">'), ("http://n.net/x", '<link rel=canonical href="mailto:a@b.c">')]
    strip = lambda u: u.split("://")[1].split("#")[0]
    want = {(strip(page), strip(urljoin(b, t))) for b in (page, "http://h.net/base/") for t in targets} | {("m.net", f"m.net/{x}") for x in ("one", "two", "three", "four")}
    assert {tuple(r) for r in urls.link_edges(spark.createDataFrame(rows, "url string, html string")).collect()} == want


def test_url_filters(spark):
    rows = [(1, "http://A.org/x", None), (2, "https://m.Example.org/es/1", ""), (3, "https://example.org/en/12?q#f", None), (4, "http://x.com/fr/", None), (5, "http://x.com/de", None), (6, "http://x.com/de/#a", None), (7, None, None), (8, "no-scheme/de/", None), (9, "http://y.net", None), (9, "http://y.net", None)]
    rows += [(20, "http://alias.net/a", '<link rel="canonical" href="https://x.com/de/1">'), (21, "http://other.net/b", "<meta http-equiv=refresh content='0; url=http://alias.net/a'>"), (22, "http://both.net/c", '<LINK href="http://alias2.net/q" rel=canonical>'), (23, "http://alias2.net/q", '<link rel=canonical href="http://example.org/es/9">'), (24, "http://third.net/z", '<link rel=canonical href="http://alias2.net/q">'), (25, "http://alias2.net/q2", '<link rel=canonical href="//good.org/1">'), (26, "http://r.com/de/s", '<link rel=canonical href="/en/s">'), (27, "http://r.com/en/s", None)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, html string, host string, verdict string")).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == (None, "allow") and got[6][2:] == ("com/de/", "block") and got[7] == ("", "", None, "allow") == got[8] and got[9] == ("y.net", "", None, "allow")
    assert [got[k][3] for k in (20, 21)] == ["block", "block"] and got[20][2] is None  # carried over two hops
    assert [got[k][3] for k in (22, 23, 24)] == ["block"] * 3 and got[25][3] == "allow" and got[27][3] == "block"


def test_linked_pages_by_sql_and_union_find(spark, tmp_path):
    """1,200 pages in chains, stars and rings of canonical links and refreshes, some under a rule."""
    import duckdb

    rng = random.Random(13)
    hosts = ["a.net", "b.net", "M.example.org", "x.com", "y.org", "c.io"]
    url = lambda i: f"http://{hosts[i % 6]}/{('de', 'es', 'fr', 'q')[i // 6 % 4]}/{i}"
    rows, parent = [], list(range(1200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(1200):
        to = rng.choice((None, i - 1, i // 7, rng.randrange(1200), i))
        html_text = "" if to is None else f'<link rel="canonical" href="{url(to)}#x">' if rng.random() < 0.5 else f"<meta http-equiv=refresh content='0; url={url(to).replace('http:', 'https:')}'>"
        if rng.random() < 0.7:
            html_text, to = "<p>none</p>", None
        rows.append((i, url(i), html_text))
        if to is not None:
            parent[find(i)] = find(to)
    pages = spark.createDataFrame([*rows, (5000, None, None), (5001, url(3), None)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    columns = ("page_id", "host", "path", "rule", "verdict")
    got = sorted((tuple(r[c] for c in columns) for r in queries.op9_url_filters(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == sorted((tuple(r) for r in con.sql(f"select {', '.join(columns)} from ({queries.ORACLES['op9_url_filters']})").fetchall()), key=repr)

    def ruled(i):
        host, path = hosts[i % 6].lower(), "/" + url(i).split("/", 3)[3]
        fits = [(len(h + p), a) for a, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    said = collections.defaultdict(set)
    for i in range(1200):
        said[find(i)].add(ruled(i))
    want = {i: ruled(i) or ("block" if "block" in said[find(i)] and "allow" not in said[find(i)] else "allow") for i in range(1200)}
    assert {r[0]: r[4] for r in got if r[0] < 1200} == want
    carried = [i for i in want if ruled(i) is None and want[i] == "block"]
    assert len(carried) > 10


def test_explicit_allow_goes_first(spark):
    rows = [(1, "http://a.net/1", '<link rel=canonical href="http://x.com/de/1">'), (2, "http://a.net/2", '<link rel=canonical href="http://x.com/de/1">'), (3, "http://good.org/p", '<link rel=canonical href="http://a.net/2">')]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow"}


def test_empty_tables(spark, none, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    frames = [quality.quality_report(none, labels), quality.keep_good(none, labels), chosenpath.near_duplicates(none), chosenpath.keep_one(none), pii.pii_report(none), pii.sanitise(none), mixing.mix_sources(none, None, 4, "doc_id"), mixing.in_mixed_order(none), html.main_text(pages), runindex.byte_dedup(none), automata.substring_dedup(none), urls.judge_urls(pages), decontaminate.find_leaks(none, bench), decontaminate.remove_leaks(none, bench)]
    assert [f.count() for f in frames] == [0] * len(frames)
    tokens.write_shards(none, f"file://{tmp_path}/s", queries.vocabulary_path())
    assert tokens.read_shards(spark, f"file://{tmp_path}/s").count() == 0


def test_text_chunks_of_sliced_and_null_columns():
    import pyarrow as pa

    column = pa.array(["x", None, "ab", "", "cde"]).slice(1)
    got = [(at, bytes(buf), offsets.tolist()) for at, buf, offsets in arrays.text_chunks(column, 2)]
    assert b"".join(b for _, b, _ in got) == b"abcde" and sum(len(o) - 1 for _, _, o in got) == 4
