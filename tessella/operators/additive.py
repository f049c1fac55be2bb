"""Scores that are sums over features, of many questions for many rows, and the best rows of each question as they come.

Features that many questions have are columns of a matrix product; the others are added where they meet. Scores are whole
halves and kept doubled, so all sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK, ROWS = 2048, 2048  # questions and rows of one product
COMMON = 0.02  # share of the questions from which on a feature is a column
WAITING = 2_000_000  # rows held before the lists are cut


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class Postings:
    """(question, weight) of each feature, by blocks of questions."""

    def __init__(self, question: list[int], feature: list[int], weight: list[float], features: int, questions: int):
        f, q, w = np.array(feature, np.int64), np.array(question, np.int64), np.array(weight, np.float32)
        order = np.lexsort((q, f))
        self.feature, self.question, self.weight = f[order], q[order], w[order]
        self.blocks = max(1, -(-questions // BLOCK))
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(self.feature * self.blocks + self.question // BLOCK, minlength=features * self.blocks))])

    def pairs(self, block: int, features: np.ndarray, rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in the block's table of questions by rows, weight) of features found in rows."""
        at = features * self.blocks + block
        counts = self.ends[at + 1] - self.ends[at]
        own = ranges(self.ends[at], counts)
        return (self.question[own] - block * BLOCK) * width + np.repeat(rows, counts), self.weight[own]


class Weights:
    """The features of the questions, split into columns of the product and sparse ones."""

    def __init__(self, postings: Postings, questions: int):
        self.postings, self.questions = postings, questions
        size = np.bincount(postings.feature, minlength=(len(postings.ends) - 1) // postings.blocks)
        common = size >= max(2, COMMON * questions)
        self.column = np.where(common, np.cumsum(common) - 1, -1)
        self.columns = int(common.sum())
        own = np.flatnonzero(common[postings.feature])
        own = own[np.argsort(postings.question[own], kind="stable")]
        self.q, self.c, self.w = postings.question[own], self.column[postings.feature[own]], postings.weight[own]

    def block(self, a: int, b: int, more: int) -> np.ndarray:
        """The weights of questions a to b, with so many empty columns after them."""
        out = np.zeros((b - a, self.columns + more), np.float32)
        i, j = np.searchsorted(self.q, [a, b])
        np.add.at(out.ravel(), (self.q[i:j] - a) * out.shape[1] + self.c[i:j], self.w[i:j])
        return out


class Best:
    """The k best rows of each list, by score, then by id; scores of 0 and below do not count."""

    def __init__(self, lists: int, k: int):
        self.k, self.floor, self.held, self.waiting, self.kept = k, np.ones(lists, np.float32), [], 0, 0
        self.ids: list[str] = []

    def offer(self, at: int, scores: np.ndarray, first: int, use: np.ndarray | None = None) -> None:
        """Scores of lists from `at` on for rows from `first` on, in the order of their ids; only those of use."""
        n, r = scores.shape
        hit = scores >= self.floor[at : at + n, None]
        if use is not None:
            hit &= use
        if np.count_nonzero(hit) > 2 * self.k * n and self.k < r:
            keys = np.where(hit, scores, -1).astype(np.int64) * r + np.arange(r - 1, -1, -1)
            least = np.partition(keys, r - self.k, axis=1)[:, r - self.k]
            hit &= keys >= least[:, None]
            self.floor[at : at + n] = np.maximum(self.floor[at : at + n], least // r)
        found = np.flatnonzero(hit)
        self.add(found // r + at, scores.ravel()[found], found % r + first)

    def add(self, lists: np.ndarray, scores: np.ndarray, rows: np.ndarray) -> None:
        self.held.append((lists.astype(np.int32), scores.astype(np.float32), rows.astype(np.int32)))
        self.waiting += len(lists)
        if self.waiting > max(WAITING, self.kept):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, score, row) of the best so far, in order; a row of one list counts once, at its greatest score."""
        q, s, r = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int32))
        good = s >= self.floor[q]
        q, s, r = q[good], s[good], r[good]
        used, place = np.unique(r, return_inverse=True)
        rank = np.argsort(np.argsort(np.array([self.ids[i] for i in used], object), kind="stable"), kind="stable") if len(used) else used
        order = np.lexsort((rank[place], -s, q)) if len(used) else place
        q, s, r = q[order], s[order], r[order]
        if len(q):
            first = np.sort(np.unique(q.astype(np.int64) * (len(self.ids) + 1) + r, return_index=True)[1])
            q, s, r = q[first], s[first], r[first]
            new = np.flatnonzero(np.diff(q, prepend=-1))
            nth = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
            last = nth == self.k - 1
            self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])
            q, s, r = q[nth < self.k], s[nth < self.k], r[nth < self.k]
        self.held, self.waiting, self.kept = [(q, s, r)], 0, len(q)
        return q, s, r

    def pieces(self, size: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The best rows as (list, score, id)."""
        q, s, r = self.cut()
        ids = np.array(self.ids, object)
        for at in range(0, len(q), size):
            yield q[at : at + size], s[at : at + size], ids[r[at : at + size]]
