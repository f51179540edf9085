"""Secrets of any length."""

import random
import time

from txweave.llm import pii

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def test_long_secrets_are_found(spark):
    rng = random.Random(5)
    key = lambda n: "".join(rng.choice(ALPHABET) for _ in range(n))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def row(i):
        kinds = [f'token = "{key(rng.randint(40, 200))}" y', f"mail a{i}.b@mail{i % 9}.example.com now", f"call +1 (234) 555-{digits(4)} x", f"version {i % 9}.{i % 7} of {i % 50} items 12 34", f"host 10.{i % 250}.{i % 99}.7 up", f"see {digits(16)} there"]
        return (i, kinds[i % len(kinds)])

    rows = [row(i) for i in range(1500)]
    detector = pii.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert detector.model is not None
    for n in (600, 5000):
        text = f'see token = "{key(n)}" end'
        assert [(pii.KINDS[k], i, j) for i, k, j, _ in detector.added([text], [pii.base_spans(text)])[0]] == [("secret", 13, 13 + n)]
        assert pii.redacted([text], detector) == ['see token = "[SECRET]" end']
    start = time.time()
    (one,) = [c for c in pii.candidates("secret: " + key(2_000_000), []) if c.end - c.start == 2_000_000]
    assert one.features[0] == 2_000_000 and time.time() - start < 30
