"""The ten operators against plain Python, on small messy tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from txweave.llm import media, mixing, packing, pii, quality_gam, quality_rules, simhash, substring, suffixes, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, bucket string, _key int, n_words string"


def words(t):
    return WORD.findall(t or "")


def messy():
    rng = random.Random(3)
    vocabulary = ["the", "a", "Zürich", "of", "naïve", "x", "data", "ÉTÉ", "spark", "run,", "end.", "—", "日本"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = prose(60), prose(12)
    texts = [None, "", " \t\n", "one", "one two", passage, passage, prose(30) + " " + passage + " " + prose(30), prose(25) + " " + passage, (line + "\n") * 6]
    texts += ["### $$$ " * 40, "SHOUT!! LOUD!! " * 40, prose(3000), "a" * 3000, "é" * 500 + " " + "é" * 500, " ".join(["same"] * 200)]
    texts += [prose(rng.randint(1, 200)) for _ in range(30)]
    near = prose(400).split()
    for k in range(6):
        changed = list(near)
        changed[k] = "changed"
        texts.append(" ".join(changed))
    rows = [(i, t, "en", [None, "b", "a", "ä"][i % 4], len(t or ""), True, "z", i, "w") for i, t in enumerate(texts)]
    return rows + [rows[5], rows[5], (None, "no id here", "en", "b", 10, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(messy(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (7, 1, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")


def by_key(rows):
    return sorted(rows, key=repr)


def kept_words(t, window, counts):
    w = words(t)
    gone = [False] * len(w)
    for s in range(len(w) - window + 1):
        if counts[tuple(w[s : s + window])] > 1:
            gone[s : s + window] = [True] * window
    return [x for x, g in zip(w, gone, strict=True) if not g], gone


@pytest.mark.parametrize(("window", "limit"), [(35, 4096), (6, 4096), (35, 2), (6, 9)])
def test_substring_dedup(docs, window, limit):
    counts = collections.Counter(tuple(w[i : i + window]) for _, t, *_ in messy() for w in [words(t)] for i in range(len(w) - window + 1))
    expected = []
    for d, t, *_ in messy():
        kept, gone = kept_words(t, window, counts)
        expected.append((d, len(gone), sum(gone), " ".join(kept)))
    out = substring.repeated_passages(docs, window, limit)
    assert by_key((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == by_key(expected)
    for r in out.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


@pytest.mark.parametrize(("window", "gram", "limit"), [(200, 48, 4096), (20, 8, 4096), (200, 48, 2), (20, 8, 9)])
def test_suffix_dedup(docs, window, gram, limit):
    raw = [(d, (t or "").encode()) for d, t, *_ in messy()]
    counts = collections.Counter(b[i : i + window] for _, b in raw for i in range(len(b) - window + 1))
    expected = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if counts[b[s : s + window]] > 1:
                gone[s : s + window] = True
        expected.append((d, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    out = suffixes.repeated_bytes(docs, window, gram, limit).collect()
    assert by_key((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out) == by_key(expected)


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(2)
    for alphabet in (1, 2, 4):
        data = rng.integers(97, 97 + alphabet, 400).astype(np.uint8)
        starts = rng.permutation(380)
        order = starts[suffixes.merge_sort(suffixes.Text(data, 20, suffixes.BASES[0]), starts)]
        raw = data.tobytes()
        assert [raw[i : i + 20] for i in order] == sorted(raw[i : i + 20] for i in starts)
        group = rng.integers(0, 3, 380)
        order = suffixes.merge_sort(suffixes.Text(data, 20, suffixes.BASES[0]), starts, group)
        assert [(group[k], raw[starts[k] : starts[k] + 20]) for k in order] == sorted((group[k], raw[starts[k] : starts[k] + 20]) for k in range(380))
        number = suffixes.classes(data, starts, 20)
        assert all((number[a] == number[b]) == (raw[starts[a] : starts[a] + 20] == raw[starts[b] : starts[b] + 20]) for a in range(60) for b in range(60))


def around(rng, n, make):
    """Runs of 3 windows of 9 around one anchor, several equal in some windows only, as texts with weights."""
    core = make(rng, 7)
    sides = [(make(rng, 2), make(rng, 2)) for _ in range(3)]
    return [(sides[rng.integers(3)][0], core, sides[rng.integers(3)][1]) for _ in range(n)]


def test_the_sort_decides_what_recurs(monkeypatch):
    rng = np.random.default_rng(5)
    made = around(rng, 12, lambda r, n: r.integers(97, 123, n).astype(np.uint8).tobytes())
    texts = sorted({b"".join(x) for x in made})
    n = len(texts)
    runs = suffixes.Texts(np.full(n, 7, np.uint64), np.full(n, 2), np.full(n, 3), np.ones(n, int), texts)
    counts = collections.Counter((k, t[k : k + 9]) for t in texts for k in range(3))
    expected = [counts[k, t[k : k + 9]] > 1 for t in texts for k in range(3)]
    assert suffixes.decide(runs).tolist() == expected and 0 < sum(expected) < len(expected)
    monkeypatch.setattr(suffixes, "merge_sort", lambda text, starts, group=None: np.arange(len(starts)))
    assert suffixes.decide(runs).tolist() != expected


def test_hits_are_extended_word_by_word():
    rng = np.random.default_rng(6)
    made = around(rng, 12, lambda r, n: b"".join(b"w%d " % k for k in r.integers(0, 1000, n)))
    texts = sorted({b"".join(x) for x in made})
    n = len(texts)
    runs = substring.Texts(np.full(n, 7, np.uint64), np.full(n, 2), np.full(n, 3), np.ones(n, int), texts)
    split = [t.split() for t in texts]
    counts = collections.Counter(tuple(s[k : k + 9]) for s in split for k in range(3))
    assert substring.decide(runs).tolist() == [counts[tuple(s[k : k + 9])] > 1 for s in split for k in range(3)]


def test_quality_base_counts(docs, labels):
    expected = []
    for d, t, *_ in messy():
        w = words(t)
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        expected.append((d, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)))
    out = quality_rules.quality_rules(docs, labels).collect()
    assert by_key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == by_key(expected)
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert by_key(r.doc_id for r in kept.collect()) == by_key(r.doc_id for r in out if r.kept)


def test_binomial_tail_and_risk(spark):
    from math import comb

    rows = [(k, n) for n in (1, 5, 40) for k in range(0, n + 1, 3)]
    got = spark.createDataFrame(rows, "k int, n int").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(min(1, sum(comb(r.n, j) * 0.1**j * 0.9 ** (r.n - j) for j in range(r.k + 1))), rel=1e-9)
    # 4000 good holdouts of one stratum: one metric is safe to cut at 0.03 and above, none of them lower.
    base = {r: F.lit(0.0) for r in quality_rules.RULES} | {"symbol_share": F.when(F.col("id") % 10 == 0, 0.025).otherwise(0.0), "mean_word": F.lit(50.0)}
    measured = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(1).alias("stratum"), F.lit(False).alias("base_failed"), *(c.alias(r) for r, c in base.items()))
    good = measured.select("doc_id", F.lit(1).alias("quality"))
    (row,) = quality_rules.choose_cutoffs(measured, good).collect()
    assert (row.cut_symbol_share, row.cut_mean_word, row.cut_upper_share) == (0.03, None, 0.05)
    assert quality_rules.choose_cutoffs(measured.limit(100), good).count() == 0  # too few to be sure of anything


def test_mixing(docs):
    rows = [(d, s, len(words(t))) for d, t, _, s, *_ in messy()]
    size = collections.Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(size.values())
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if rest * weight[s] / total > 2 * size[s]]
        if not over:
            target |= {s: rest * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            rest -= target[s]
            open_.discard(s)
    out = mixing.systematic(docs, buckets=5).collect()
    assert by_key((r.doc_id, r.source, r.size, r.source_size) for r in out) == by_key((d, s, n, size[s]) for d, s, n in rows)
    assert all(r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 2 for r in out)
    for s in names:  # as many copies as the sum of expectations, within one
        assert abs(sum(r.copies for r in out if r.source == s) - target[s] / size[s] * sum(x == s for _, x, _ in rows)) <= 1
    assert by_key(mixing.systematic(docs, buckets=5).collect()) == by_key(out)
    mixed = mixing.mixed_documents(docs, buckets=5)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({d: n for d, n in [(r.doc_id, sum(x.copies for x in out if x.doc_id == r.doc_id)) for r in out] if n})


def plain_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(docs):
    rows = messy()
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(fps)
    least = {}
    for (d, *_), r in zip(rows, roots, strict=True):
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    expected = [(d, f, least[r]) for (d, *_), f, r in zip(rows, fps, roots, strict=True)]
    out = simhash.simhash_components(docs).collect()
    assert by_key((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == by_key(expected)
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len(set(roots))


@pytest.mark.parametrize("compare", [1, 8, 10_000])
def test_simhash_links_in_crowded_keys(spark, monkeypatch, compare):
    monkeypatch.setattr(simhash, "COMPARE_MOST", compare)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 3)
    fps = {int(b) for b in base}
    for b in base:  # clouds of fingerprints a few bits around a centre, and a chain of single steps
        fps |= {int(b) ^ sum(1 << int(i) for i in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5, 6) for _ in range(12)}
    chain = int(base[0])
    for bit in range(0, 60, 2):
        chain ^= 3 << bit
        fps.add(chain)
    fps = sorted(fps)
    group = np.zeros(len(fps), np.int64)
    a, b = simhash._links(group, np.array(fps, np.uint64))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        parent[max(find(x), find(y))] = min(find(x), find(y))
    roots = plain_components(fps)
    assert [find(f) for f in fps] == [fps[r] for r in roots]
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(simhash.links(signed)).collect()}
    groups = collections.defaultdict(set)
    for f, r in zip(fps, roots, strict=True):
        groups[r].add(found.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def plain_base(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_pii_base_equals_the_patterns():
    rng = random.Random(8)
    parts = ["a@b.c", "@", ".", "x.y@z-1.co.uk", "1.2.3.4", "1.2.3.400", "001.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 555-6789", "+", "12", " ", "é", "-", "@a.b@c.d", "1234567890123456789012"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert pii.base_spans(t) == plain_base(t), t
    long = "a" * 200_000 + "@" + "1" * 200_000 + " 1.1" * 1000 + "(" * 100_000
    pii.base_spans(long), pii.candidates(long, [])  # in linear time


def test_pii_adds_and_redacts(spark, docs):
    rng = random.Random(9)

    def row(i):
        card = "".join(rng.choice("0123456789") for _ in range(15))
        card += next(c for c in "0123456789" if pii.luhn(card + c))
        secret = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        kinds = [f"see {card} there", f"mail a{i}.b@mail{i % 9}.example.com now", f"call +1 (234) 555-{rng.randint(1000, 9999)} x", f'token = "{secret}" y', f"version {i % 9}.{i % 7} of {i % 50} items 12 34", f"host 10.{i % 250}.{i % 99}.7 up"]
        return (i, kinds[i % len(kinds)])

    corpus = spark.createDataFrame([row(i) for i in range(1500)], "doc_id long, text string")
    detector = pii.fit(corpus)
    assert detector.model is not None
    text = 'token = "0123456789abcdef0123456789abcdef01234567" version 2.0 of 12'
    assert [pii.KINDS[k] for _, k, _, _ in detector.added([text], [pii.base_spans(text)])[0]] == ["secret"]
    assert pii.redacted(["mail a.b@c.example.com or 1.2.3.4.", ""], detector) == ["mail [EMAIL] or [IP].", ""]
    out = pii.redact(docs, detector)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert pii.fit(docs).model is None  # nothing to learn from
    assert pii.find(docs).where(F.size("base") > 0).count() == 0


def test_quality_gam(spark, docs, empty):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choice(["alpha", "beta,", "gamma.", "delta", "Epsilon"]) for _ in range(80))) for i in range(300)]
    bad = [(i, "### WIN $$$ " * rng.randint(10, 40)) for i in range(300, 450)]
    known = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = known.select("doc_id", (F.col("doc_id") < 300).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    out = quality_gam.quality_scores(known, marks).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum((r.doc_id < 300) == (r.predicted == 1) for r in held) >= 0.97 * len(held) > 0
    model = quality_gam.train(np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 200, float), np.array([0, 1, 1, 0] * 200, float))
    assert model.pairs == [(0, 1)] and (model.score(np.array([[0, 1], [1, 1]], float)) > 0.5).tolist() == [True, False]
    none = marks.limit(0)
    assert {r.score for r in quality_gam.quality_scores(docs, none).collect()} == {0.5}
    assert quality_gam.quality_scores(empty, none).count() == 0


def test_url_filter(spark):
    urls = [f"http://www.good{i}.com/en/{i}" for i in range(60)] + [f"https://spam{i}.net/es/{i}?q" for i in range(60)]
    urls += ["http://a.EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://example.com/en", "http://x.org/en/", "http://spam3.net/de/77", "nothing", "", None, "http://com?x", "http://com/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, None)], "page_id long, url string")
    rows = url_filter.judged(pages).collect()
    assert len(rows) == len(urls) + 2
    out = {r.url: r for r in rows}
    assert (out["http://a.EXAMPLE.com/en/1"].rule, out["http://a.EXAMPLE.com/en/1"].verdict, out["http://a.EXAMPLE.com/en/1"].host) == ("example.com/en/", "block", "a.example.com")
    assert (out["http://www.example.com/en/1"].rule, out["http://www.example.com/en/1"].verdict) == ("www.example.com/en/", "allow")
    assert out["http://example.com/en"].rule == "com/" and out["http://com/"].rule == "com/" and out["http://com?x"].rule is None
    assert out["http://spam3.net/de/77"].rule is None and out["http://spam3.net/de/77"].verdict == "allow"  # too few to calibrate on
    assert [(out[u].host, out[u].path) for u in ("nothing", "", None)] == [("", "")] * 3
    assert url_filter.judged(pages.limit(0)).count() == 0


def test_packing(docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    odd = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a <|endoftext|> b 's  \n\n x")).withColumn("doc_id", F.lit(5000).cast("long")))
    out = packing.best_fit_packing(odd, with_ids=True, groups=3).collect()
    of = collections.defaultdict(list)
    for r in out:
        of[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length <= 2048
    for d, t in [(d, t) for d, t, *_ in messy()] + [(5000, "a <|endoftext|> b 's  \n\n x")]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        starts = [0, *range(len(ids) % 2048 or 2048, len(ids), 2048)]
        wanted = [(k, s) for k, s in enumerate(starts)]
        assert set(wanted) <= {(r.piece, r.start) for r in of[d]}
        assert any(list(r.ids) == ids[: r.length] for r in of[d] if r.start == 0)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append(r)
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert packing.best_fit_packing(empty).count() == 0


def test_leftovers_are_packed_together(spark):
    """However many groups, no more sequences than what whole groups' tokens need and one."""
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, 0, 0, rng.randint(1, 400), i) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    out = packing.pack(rows, groups=40).collect()
    need = -(-sum(r.length for r in out) // packing.CAPACITY)
    assert len(out) == 3000 and len({r.sequence_id for r in out}) <= need + 1
    bound = packing.pack(rows, (packing.CAPACITY, 5, packing.CAPACITY**2), groups=4).collect()
    filled = collections.Counter(r.sequence_id for r in bound)
    assert max(filled.values()) == 5 and len(filled) >= 600


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    lengths = np.sort(np.random.default_rng(1).integers(1, 900, 400))[::-1]
    caps = (1000, 4, 850_000)
    which, offset = packing.best_fit(lengths, caps, (1.0, 0.5, 0.5), score)
    for b in np.unique(which):
        own = lengths[which == b]
        assert own.sum() <= caps[0] and len(own) <= caps[1] and (own.astype(float) ** 2).sum() <= caps[2]
        assert sorted(offset[which == b]) == np.r_[0, np.cumsum(own)[:-1]].tolist()
    assert which.max() + 1 <= 1.5 * max(lengths.sum() / caps[0], len(lengths) / caps[1], (lengths.astype(float) ** 2).sum() / caps[2])


def test_media_round_trip(docs, empty):
    out = media.describe(media.store(docs)).collect()
    expected = []
    for d, t, *_ in messy():
        b = (t or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        expected.append((d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert by_key((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == by_key(expected)
    assert media.describe(media.store(empty)).count() == 0


def test_media_tables():
    for n in (1, 8, 9, 40):
        payload = np.random.default_rng(n).integers(0, 256, n * 64).astype(np.uint8).tobytes()
        data = media.mux(payload)
        (track,) = media.probe(data)
        assert media.read_samples(data, track) == payload and (track.codec, len(track.sizes), track.duration) == ("dat8", n, n * 40)
        units = [payload[k * 64 : k * 64 + 64] for k in range(n)]
        assert [data[i:j] for i, j in track.key_ranges()] == [u for k, u in enumerate(units) if not k or sum(u) % 16 == 0]
    # Other layouts than ours: two tracks, sizes of each sample, chunks apart, 64-bit offsets, no list of keyframes.
    import struct

    def trak(codec, sizes, offsets, stsc):
        table = lambda v, f: struct.pack(">I", len(v)) + b"".join(struct.pack(f, *x) if isinstance(x, tuple) else struct.pack(f, x) for x in v)
        stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(codec, bytes(8))), media.full(b"stsz", struct.pack(">I", 0), table(sizes, ">I")), media.full(b"stsc", table(stsc, ">III")), media.full(b"co64", table(offsets, ">Q")))
        return media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90, 450, 0, 0)), media.box(b"minf", stbl)))

    moov = media.box(b"moov", trak(b"avc1", [3, 5, 2], [100, 200], [(1, 2, 1), (2, 1, 1)]), trak(b"mp4a", [4], [300], [(1, 1, 1)]))
    first, second = media.probe(media.box(b"free", bytes(5)) + moov)
    assert (first.codec, first.timescale, first.duration, first.offsets.tolist()) == ("avc1", 90, 450, [100, 103, 200])
    assert first.key_ranges() == [(100, 103), (103, 108), (200, 202)] and second.offsets.tolist() == [300]
    with pytest.raises(ValueError, match="bad size"):
        media.probe(struct.pack(">I4s", 99, b"moov"))


def test_fragmented_media():
    import struct

    stbl = media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(8))), media.full(b"stsz", struct.pack(">II", 0, 0)), media.full(b"stsc", struct.pack(">I", 0)), media.full(b"stco", struct.pack(">I", 0)))
    tkhd = media.full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(72))
    trak = media.box(b"trak", tkhd, media.box(b"mdia", media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 90, 0, 0, 0)), media.box(b"minf", stbl)))
    trex = media.full(b"trex", struct.pack(">5I", 7, 1, 10, 4, 0x10000))
    moov = media.box(b"moov", trak, media.box(b"mvex", trex))

    def moof(payloads, runs):
        """A moof of one traf and its mdat; the truns' data offsets count from the moof."""

        def made(shift):
            at, truns = shift, []
            for flags, sizes, first in runs:
                rows = b"".join(struct.pack(">I", s) for s in sizes) if flags & 0x200 else b""
                truns.append(media.full(b"trun", struct.pack(">Ii", len(sizes), at), struct.pack(">I", first) * bool(flags & 4), rows, flags=flags | 1))
                at += sum(sizes)
            return media.box(b"moof", media.box(b"traf", media.full(b"tfhd", struct.pack(">I", 7), flags=0x20000), *truns))

        return made(len(made(0)) + 8) + media.box(b"mdat", payloads)

    first = moof(b"aaaabbbbcc", [(4, [4, 4], 0), (0x200, [2], 0)])
    data = moov + first + moof(b"ddddee", [(0x204, [4, 2], 0)])
    (track,) = media.probe(data)
    assert media.read_samples(data, track) == b"aaaabbbbccddddee" and track.duration == 50 and track.sizes.tolist() == [4, 4, 2, 4, 2]
    assert [data[i:j] for i, j in track.key_ranges()] == [b"aaaa", b"dddd"]


def test_broken_media_raise_value_errors():
    rng = random.Random(4)
    good = media.mux(bytes(range(64)) * 3)
    deep = b""
    for _ in range(400):
        deep = media.box(b"moov", deep)
    for data in [deep, good[: len(good) // 2], good.replace(b"mdhd", b"free"), good.replace(b"stsc", b"free"), good.replace(b"stco", b"free")]:
        with pytest.raises(ValueError, match=r"bad size|too deep|broken"):
            media.probe(data)
    for _ in range(300):
        data = bytearray(good)
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            media.probe(bytes(data))
        except ValueError:
            pass


def test_empty_tables(empty, labels):
    assert substring.repeated_passages(empty).count() == 0
    assert suffixes.repeated_bytes(empty).count() == 0
    assert quality_rules.quality_rules(empty, labels).count() == 0 == quality_rules.keep_good(empty, labels).count()
    assert mixing.systematic(empty).count() == 0 == mixing.mixed_documents(empty).count()
    assert simhash.simhash_components(empty).count() == 0 == simhash.one_of_each(empty).count()
    assert pii.find(empty).count() == 0 == pii.redact(empty).count()
