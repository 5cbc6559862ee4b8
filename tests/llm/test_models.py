"""The two learned models against plain versions of their own."""

import math
import random

import numpy as np

from siftlark.llm import quality
from siftlark.llm.ftrl import Features, Ftrl
from tests.llm.conftest import words


def plain_ftrl(rows, labels, order, bits, alpha, beta, l1, l2, bias_z, bias_n):
    """FTRL-proximal with dictionaries, one coordinate at a time."""
    bias, z, n = 1 << bits, {1 << bits: bias_z}, {1 << bits: bias_n}

    def weight(i):
        zi, ni, least = z.get(i, 0.0), n.get(i, 0.0), 0.0 if i == bias else l1
        if abs(zi) <= least:
            return 0.0
        return -(zi - math.copysign(least, zi)) / ((beta + math.sqrt(ni)) / alpha + l2)

    for row in order:
        at = [*rows[row].tolist(), bias]
        p = 1 / (1 + math.exp(-min(max(sum(weight(i) for i in at), -35), 35)))
        g = p - labels[row]
        for i, w in [(i, weight(i)) for i in at]:
            before = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w
            n[i] = before + g * g
    return {i: weight(i) for i in z}


def test_ftrl_matches_a_plain_version():
    draw, bits = random.Random(6), 12
    features = Features(bits)
    rows = [features(" ".join(words(i, 12) + (["vile"] if i % 3 == 0 else []))) for i in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    order = [draw.randrange(60) for _ in range(300)]
    model = Ftrl(bits, l1=1.0)
    model.start_from(0.3)
    start = (float(model.z[model.bias]), float(model.n[model.bias]))
    for row in order:
        model.learn(rows[row], labels[row])
    told = plain_ftrl(rows, labels, order, bits, model.alpha, model.beta, model.l1, model.l2, *start)
    at, weights = model.nonzero()
    found = dict(zip(at.tolist(), weights.tolist()))
    assert all(abs(found.get(i, 0.0) - w) < 1e-9 for i, w in told.items()) and set(found) <= set(told)
    assert sum(w != 0 for w in told.values()) > 1


def plain_em(votes, steps):
    """EM over every document, not over patterns."""
    k = len(quality.RULES)
    bad, hit, false_hit = quality.PRIOR_BAD, [quality.PRIOR_HIT] * k, [quality.PRIOR_FALSE_HIT] * k
    for _ in range(steps):
        good_of = []
        for row in votes:
            odds = math.log(1 - bad) - math.log(bad)
            for j, v in enumerate(row):
                odds += 0.0 if v is None else math.log(false_hit[j] / hit[j]) if v == 0 else math.log((1 - false_hit[j]) / (1 - hit[j]))
            good_of.append(1 / (1 + math.exp(-odds)))
        rate = lambda j, share, prior: (sum(s for s, r in zip(share, votes) if r[j] == 0) + quality.PRIOR_DOCS * prior) / (sum(s for s, r in zip(share, votes) if r[j] is not None) + quality.PRIOR_DOCS)
        bad_of = [1 - g for g in good_of]
        after = (
            min(max((sum(bad_of) + quality.PRIOR_DOCS * quality.PRIOR_BAD) / (len(votes) + quality.PRIOR_DOCS), 0.01), 0.5),
            [min(max(rate(j, bad_of, quality.PRIOR_HIT), 0.05), 0.95) for j in range(k)],
            [min(max(rate(j, good_of, quality.PRIOR_FALSE_HIT), 0.0005), 0.04) for j in range(k)],
        )
        moved = max(abs(a - b) for a, b in zip((after[0], *after[1], *after[2]), (bad, *hit, *false_hit)))
        bad, hit, false_hit = after
        if moved < 1e-4:
            break
    return bad, hit, false_hit


def test_em_matches_a_plain_version(spark):
    draw, rows = random.Random(3), []
    for _ in range(900):
        junk = draw.random() < 0.2
        rows.append(tuple(None if draw.random() < 0.2 else 0 if draw.random() < (0.5 if junk else 0.02) else 1 for _ in quality.RULES))
    model = quality.fit(spark.createDataFrame(rows, ", ".join(f"{r.name} int" for r in quality.RULES)))
    bad, hit, false_hit = plain_em(rows, 12)
    assert np.allclose([model.bad_share, *model.hit, *model.false_hit], [bad, *hit, *false_hit], atol=1e-9)
