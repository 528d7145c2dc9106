"""Main text of pages by a linear-chain conditional random field over their leaf blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .html_blocks import Block, blocks_of, features_of
from .html_labelled import labelled_page

#: The model learns from so many labelled pages; it is the same for any input.
TRAIN_PAGES, EPOCHS, RATE, DECAY = 500, 8, 0.25, 1e-4


def _add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m)) if m > -math.inf else m


class Chain:
    """Labels 0 and 1 along a page: a block's score is that of label 1, label 0 having 0; move[x][y] scores neighbours."""

    def __init__(self, weights: dict[str, float], move: list[list[float]]):
        self.weights, self.move = weights, move

    def scores(self, features: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in fs) for fs in features]

    def decode(self, features: list[list[str]]) -> list[int]:
        """Viterbi: the labels with the highest total; of equal ones, label 0 at the last block that they differ in."""
        if not features:
            return []
        best, back = None, []
        move = self.move
        for s in self.scores(features):
            if best is None:
                best = (0.0, s)
                continue
            into = []
            step = []
            for y, own in ((0, 0.0), (1, s)):
                a, b = best[0] + move[0][y], best[1] + move[1][y]
                step.append(int(b > a))
                into.append(max(a, b) + own)
            back.append(step)
            best = tuple(into)
        y = int(best[1] > best[0])
        out = [y]
        for step in reversed(back):
            y = step[y]
            out.append(y)
        return out[::-1]

    def marginals(self, features: list[list[str]]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block, and the expected number of each move, by forward and backward sums of logs."""
        s, move, n = self.scores(features), self.move, len(features)
        fore, after = [(0.0, s[0])], [(0.0, 0.0)]
        for k in range(1, n):
            a, b = fore[-1]
            fore.append((_add(a + move[0][0], b + move[1][0]), _add(a + move[0][1], b + move[1][1]) + s[k]))
        for k in range(n - 1, 0, -1):
            a, b = after[-1][0], after[-1][1] + s[k]
            after.append((_add(move[0][0] + a, move[0][1] + b), _add(move[1][0] + a, move[1][1] + b)))
        after.reverse()
        z = _add(*fore[-1])
        one = [math.exp(fore[k][1] + after[k][1] - z) for k in range(n)]
        moves = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(1, n):
            for x in (0, 1):
                for y in (0, 1):
                    moves[x][y] += math.exp(fore[k - 1][x] + move[x][y] + (s[k] if y else 0.0) + after[k][y] - z)
        return one, moves


def train(pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Chain:
    """Maximises the regularised conditional likelihood by AdaGrad steps, page after page in the given order."""
    chain = Chain({}, [[0.0, 0.0], [0.0, 0.0]])
    squares: dict[str, float] = {}
    move_squares = [[1e-6, 1e-6], [1e-6, 1e-6]]
    for _ in range(epochs):
        for features, labels in pages:
            if not features:
                continue
            one, moves = chain.marginals(features)
            gradient: dict[str, float] = {}
            for fs, y, p in zip(features, labels, one, strict=True):
                for f in fs:
                    gradient[f] = gradient.get(f, 0.0) + y - p
            for f, g in gradient.items():
                w = chain.weights.get(f, 0.0)
                g -= decay * w
                squares[f] = squares.get(f, 1e-6) + g * g
                chain.weights[f] = w + rate * g / math.sqrt(squares[f])
            for x, y in zip(labels, labels[1:], strict=False):
                moves[x][y] -= 1.0
            for x in (0, 1):
                for y in (0, 1):
                    g = -moves[x][y]
                    move_squares[x][y] += g * g
                    chain.move[x][y] += rate * g / math.sqrt(move_squares[x][y])
    return chain


@lru_cache(maxsize=1)
def default_chain(pages: int = TRAIN_PAGES) -> Chain:
    examples = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        examples.append(([features_of(b) for b in blocks_of(page)], labels))
    return train(examples)


def main_blocks(page: str, chain: Chain) -> list[Block]:
    found = blocks_of(page)
    return [b for b, y in zip(found, chain.decode([features_of(b) for b in found]), strict=True) if y]


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars.

    The text is the blocks labelled main, in page order, joined by line feeds. Null or empty html, and pages without such
    blocks, have an empty text. Repeated rows give equal rows; ids and urls may be null. Whole pages are read; other
    columns are not.
    """
    small_batches(pages.sparkSession)
    chain = chain or default_chain()
    sent = pages.sparkSession.sparkContext.broadcast((chain.weights, chain.move))  # a few hundred weights, from labelled pages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Chain(*sent.value)
        for batch in batches:
            texts = ["\n".join(b.text for b in main_blocks(page or "", own)) for page in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
