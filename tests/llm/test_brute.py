"""Scores and spans of trained models against plain loops over the same definitions."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from brindle.llm import secrets, toxicity

# --- 6: toxicity


def plain_score(model, text):
    """The definition, word by word: windows, two recurrent passes, attention, the largest logit."""
    p, h_size = model.p, toxicity.H
    words = toxicity.WORD.findall((text or "").lower()) or [""]
    starts = [*range(0, max(1, len(words) - toxicity.WINDOW + 1), toxicity.STRIDE)]
    if len(words) > toxicity.WINDOW and starts[-1] != len(words) - toxicity.WINDOW:
        starts.append(len(words) - toxicity.WINDOW)

    def vector(word):
        grams, _ = toxicity.gram_ids([word])
        return np.concatenate([p["word"][model.words.get(word, 0)], p["gram"][grams].mean(0)])

    def passed(xs, way):
        h, out = np.zeros(h_size), []
        for x in xs:
            i, u = x @ p[f"W{way}"] + p[f"c{way}"], h @ p[f"U{way}"]
            z, r = (1 / (1 + np.exp(-(i[k : k + h_size] + u[k : k + h_size]))) for k in (0, h_size))
            c = np.tanh(i[2 * h_size :] + r * u[2 * h_size :])
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    best = -math.inf
    for at in starts:
        xs = [vector(w) for w in words[at : at + toxicity.WINDOW]]
        states = [np.concatenate(s) for s in zip(passed(xs, "f"), passed(xs[::-1], "b")[::-1], strict=True)]
        e = [float(np.tanh(s @ p["A"] + p["a"]) @ p["v"]) for s in states]
        w = [math.exp(x - max(e)) for x in e]
        pooled = sum(a * s for a, s in zip(w, states, strict=True)) / sum(w)
        best = max(best, float(pooled @ p["o"] + p["bias"][0]))
    return 1 / (1 + math.exp(-best))


def test_scores_against_a_plain_network():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["ärger", "漢字"]
    model = toxicity.BiGRU(vocabulary[:12], seed=5)
    model.p["bias"][0] = 0.3
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 2, 23, 24, 25, 39, 40, 41, 64, 200)] + [None, "", "  ?!", "W1 w2, W3-w4"]
    got = model.scores(texts)
    assert got == pytest.approx([plain_score(model, t) for t in texts], abs=2e-5)
    assert len(set(np.round(got, 6))) > 8


# --- 5: secrets


def plain_spans(texts):
    """All spans of each text, from pair counts of labelled runs kept in counters."""
    kinds, alphabet = ("assign", "access", "hex", "markov"), secrets.ALPHABET
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    found, pairs = [], (Counter(), Counter())
    for text in texts:
        text = text or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(text) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        runs = [m for m in re.finditer(r"[A-Za-z0-9+/_.=-]{8,}", text) if not any(s < m.end() and m.start() < e for s, _, e, _ in base)]
        random = [v for _, k, _, v in base if k or len(v) >= 16]
        plain = [m[0] for m in runs if secrets.PLAIN.fullmatch(m[0])]
        for side, strings in enumerate((random, plain)):
            for x in strings:
                pairs[side].update(zip(f"\n{x}", f"{x}\n", strict=True))
        found.append((base, runs))

    def logs(side):
        counts = pairs[side]
        # strings stand in lines, so the edge is counted as a second character once a string
        single = Counter()
        for (_, b), n in counts.items():
            single[b] += n
        first = Counter()
        for (a, _), n in counts.items():
            first[a] += n
        total = sum(single.values()) + 0.5 * secrets.SIZE
        share = lambda b: (single[b] + 0.5) / total
        return lambda a, b: math.log((counts[a, b] + secrets.BACKOFF * share(b)) / (first[a] + secrets.BACKOFF))

    yes, no = logs(0), logs(1)
    out = []
    for base, runs in found:
        spans = [(s, k, e) for s, k, e, _ in base]
        for m in runs:
            if len(m[0]) >= 16:
                ratio = sum(yes(a, b) - no(a, b) for a, b in zip(f"\n{m[0]}", f"{m[0]}\n", strict=True))
                if ratio > max(math.log(1e6), len(m[0])):
                    spans.append((m.start(), 3, m.end()))
        out.append(",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans)))
    assert set(alphabet) >= {c for side in pairs for p in side for c in p} - {"\n"}
    return out


def test_all_spans_against_plain_counts(spark, sf):
    import random

    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = list(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas().itertuples(index=False, name=None))
    rows += [(10_000 + i, f"key {''.join(rng.choice(letters) for _ in range(rng.randint(16, 60)))} and token={''.join(rng.choice(letters) for _ in range(24))}, see src/main/java/Some_Class.py x") for i in range(60)]
    rows += [(None, None), (1, "")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "spans").collect()
    want = [(i, s) for (i, _), s in zip(rows, plain_spans([t for _, t in rows]), strict=True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum("markov" in s for _, s in want) >= 30
