"""The URL models against a plain Python version, and rare paths against the usual ones."""

import collections
import hashlib
import math
import random

import pytest

from txweave.llm import url_filter

ALPHABET = set("abcdefghijklmnopqrstuvwxyz9:/?#[]@!&'()*+,;=._~%-")


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    tail = rest[cut:]
    stop = min((tail.find(c) for c in "?#" if c in tail), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:stop]


def rule_of(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.host + r.path), default=None)


def chars_of(url, rule):
    url = url or ""
    if "://" in url:
        host, path = split(url)
        h = max(len(rule.host) if rule else 0, len(host.rsplit(".", 1)[-1]))
        segment = 0
        if path.startswith("/"):
            end = path.find("/", 1)
            segment = end + 1 if end > 0 else len(path)
        p = max(len(rule.path) if rule else 0, segment)
        begin = url.index("://") + 3
        url = url[: begin + len(host) - h] + url[begin + len(host) + p :]
    low = "".join(c.lower() if "A" <= c <= "Z" else "9" if "0" <= c <= "9" else c for c in url)
    return "^^^" + "".join(c if c in ALPHABET else "|" for c in low) + "$"


def model(texts):
    """P(last | before) for a 4-gram by Witten-Bell smoothing, from counts of all shorter grams."""
    counts = [collections.Counter() for _ in range(4)]
    for t in texts:
        for i in range(len(t) - 3):
            for k in range(4):
                counts[k][t[i + 3 - k : i + 4]] += 1
    after = [collections.defaultdict(dict) for _ in range(4)]
    for k in range(4):
        for g, n in counts[k].items():
            after[k][g[:k]][g] = n

    def p(gram):
        value = (counts[0][gram[3:]] + 1) / (sum(counts[0].values()) + 51)
        for k in range(1, 4):
            g = gram[3 - k :]
            own = after[k].get(g[:k], {})
            if own:
                n, kinds = sum(own.values()), len(own)
                value = (own.get(g, 0) + kinds * value) / (n + kinds)
        return value

    return p


def plain(urls, rules, risk, least):
    rows = []
    for u in urls:
        host, path = split(u)
        r = rule_of(host, path, rules)
        rows.append((u, r.verdict if r else None, u is not None and hashlib.md5(u.encode()).hexdigest()[0] in "012", chars_of(u, r)))
    models = [model([c for _, v, h, c in rows if v == side and not h]) for side in ("allow", "block")]
    scores = {c: round(sum(math.log(models[0](c[i : i + 4])) - math.log(models[1](c[i : i + 4])) for i in range(len(c) - 3)) / (len(c) - 3), 9) for *_, c in rows}
    held = sorted(scores[c] for _, v, h, c in rows if v == "allow" and h)
    taught = {v for _, v, h, _ in rows if v and not h}
    cutoff = held[int(risk * len(held))] if len(held) >= least and len(taught) == 2 else -math.inf
    return [(u, scores[c], v or ("allow" if scores[c] >= cutoff else "block")) for u, v, _, c in rows]


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeorst") for _ in range(rng.randint(2, 6)))
    urls = [f"{rng.choice(['http', 'https'])}://{word()}.{word()}.{rng.choice(['com', 'net', 'org', 'ORG'])}/{rng.choice(['en', 'es', 'fr', ''])}/{word()}-{rng.randint(1, 99)}{rng.choice(['', '?q=é', '#x'])}" for _ in range(500)]
    urls += [f"http://win{word()}cash.net/es/{word()}{k}" for k in range(60)] + [f"http://win{word()}cash.org/de/{k}" for k in range(20)]
    return urls + ["http://a.EXAMPLE.com/en/1", "http://www.example.com/en/1", "http://x.org", "http://com?x", "nothing", "", None, "x://" + "long/" * 20_000, urls[0]]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_scores_and_verdicts_equal_plain_python(spark, broadcast):
    urls = corpus()
    pages = spark.createDataFrame([(k, u, "h", 1.0, "r") for k, u in enumerate(urls)], "page_id long, url string, host string, score double, rule string").repartition(3)
    out = {r.page_id: r for r in url_filter.judged(pages, least=20, risk=0.05, broadcast=broadcast).collect()}
    expected = plain(urls, url_filter.RULES, 0.05, 20)
    assert len(out) == len(urls)
    for k, (u, score, verdict) in enumerate(expected):
        assert (out[k].url, out[k].host, out[k].path) == (u, *split(u))
        assert out[k].score == pytest.approx(score, abs=2e-9), u
        assert out[k].verdict == verdict, (u, out[k].score, score)
    assert {v for *_, v in expected} == {"allow", "block"} and any(v == "block" and u and ".org" in u for u, _, v in expected)


def test_probabilities_add_up_to_one(spark):
    counts = [("^^^a", 3, 1), ("^^ab", 2, 0), ("^aba", 1, 4), ("^abb", 0, 2)]
    letters = sorted(ALPHABET | {"|", "$"})
    assert len(letters) == url_filter.ALPHABET
    rows = {g: (a, b) for g, a, b in counts} | {c + x: (0, 0) for c in ("^^^", "^ab", "zzz") for x in letters if c + x not in {g for g, *_ in counts}}
    frame = spark.createDataFrame([(g, *n) for g, n in rows.items()], "gram string, allow long, block long")
    got = {r.gram: r for r in url_filter.smoothed(frame).collect()}
    plain_model = model(["^^^a"] * 3 + ["^^ab"] * 2 + ["^aba"])
    for g in rows:
        assert got[g].p_allow == pytest.approx(plain_model(g), rel=1e-9), g
    for c in ("^^^", "^ab", "zzz"):
        assert sum(got[c + x].p_allow for x in letters) == pytest.approx(1) == sum(got[c + x].p_block for x in letters)


def test_order_statistic(spark):
    values = [0.5, 0.5, -3.0, 2.0, 1e-9, 2e-9, 1e6] * 30
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (0, 29, 30, 75, 100, 209):
        assert url_filter.order_statistic(frame, "v", rank, bins=4) == sorted(values)[rank]


def test_too_few_to_calibrate_blocks_nothing(spark):
    pages = spark.createDataFrame([(0, "http://a.com/x"), (1, "http://b.net/es/y"), (2, "http://c.org/z")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judged(pages).orderBy("page_id").collect()] == ["allow", "block", "allow"]
