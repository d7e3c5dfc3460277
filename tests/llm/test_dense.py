"""Many texts of one origin, each pair just below the threshold or just above it."""

import random
import time

import numpy as np

from tidemark.llm import minhash


def variants(n: int, words: int, changed: int, seed: int = 3) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for k in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"x{rng.randrange(6)}"
        out.append((k, " ".join(text)))
    return out


def brute(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (text.split() for _, text in rows)]
    code = {x: i for i, x in enumerate(set().union(*sets))}
    held = np.zeros((len(sets), len(code)), np.float32)
    for i, s in enumerate(sets):
        held[i, [code[x] for x in s]] = 1
    both, n = held @ held.T, held.sum(axis=1)
    comp = np.arange(len(rows))
    for i, j in zip(*np.nonzero(100 * both >= 75 * (n[:, None] + n[None, :] - both))):
        if comp[i] != comp[j]:
            comp[comp == max(comp[i], comp[j])] = min(comp[i], comp[j])
    return {i: int(c) for i, c in enumerate(comp)}


def test_dense_buckets_hold_each_pair_once(spark):
    rows = variants(500, 400, 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    took = time.perf_counter() - began
    want = brute(rows)
    assert 1 < len(set(want.values())) < len(rows)
    assert got == want
    assert took < 60
