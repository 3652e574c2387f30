"""The quality classifier's training against plain code."""

import numpy as np

from furlong.llm import quality_classifier as Q


def test_training_equals_plain_code():
    pick = np.random.default_rng(9)
    rows = []
    for i in range(14):
        index = np.sort(pick.choice(40, size=6, replace=False)).astype(np.int32)
        share = pick.random(6).astype(np.float32)
        rows.append((i % 2, index, share / share.sum()))
    got = Q.train(rows, epochs=4, rate=8.0, seed=3)
    rng = np.random.default_rng(3)
    start = (rng.random((1 << Q.BUCKET_BITS, Q.DIM), dtype=np.float32) - 0.5) / Q.DIM
    vectors = {i: [float(x) for x in start[i]] for i in range(40)}
    output, step = [[0.0] * Q.DIM, [0.0] * Q.DIM], 0
    for _ in range(4):
        for i in rng.permutation(len(rows)):
            label, index, share = rows[i]
            rate = 8.0 * (1 - step / (4 * len(rows)))
            step += 1
            hidden = [sum(float(s) * vectors[f][d] for f, s in zip(index, share, strict=True)) for d in range(Q.DIM)]
            z = [sum(o * h for o, h in zip(out, hidden, strict=True)) for out in output]
            error = [np.exp(v) / sum(np.exp(u) for u in z) - (k == label) for k, v in enumerate(z)]
            back = [sum(error[k] * output[k][d] for k in range(2)) for d in range(Q.DIM)]
            for k in range(2):
                output[k] = [o - min(rate, 1.0) * error[k] * h for o, h in zip(output[k], hidden, strict=True)]
            for f, s in zip(index, share, strict=True):
                vectors[f] = [v - rate * float(s) * b for v, b in zip(vectors[f], back, strict=True)]
    expected = [sum(v * (b - a) for v, a, b in zip(vectors[i], *output, strict=True)) for i in range(40)]
    assert np.allclose(got[:40], expected, atol=1e-3) and np.abs(expected).max() > 0.01


def test_vectors_learn_the_label():
    rows = [(k % 2, np.array([k % 2, 5 + k % 7], np.int32), np.array([0.5, 0.5], np.float32)) for k in range(40)]
    margins = Q.train(rows, epochs=20)
    assert margins[1] > 1 and margins[0] < -1
