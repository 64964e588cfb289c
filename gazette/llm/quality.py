"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

Each line has features of its own (letters, capitals, digits, marks, word lengths, repeats) and those of
the lines before and after it. The field has two states and weights for features and for transitions.
The forward-backward pass gives each line's marginal probability of being good; a document's score is
the mean of these, weighted by line length.

Fitting: lines take the label of their document. The sample is bounded: `SAMPLE_DOCS` documents per
label and `SAMPLE_LINES` neighbouring lines of each, chosen by a hash of the id. Features are worked out
on the workers, only the sample's features come to the driver; class weights restore the share of the
labels in all labelled rows. The fitted model is a few hundred numbers.

Scoring runs over every whole text, in batches of documents: the passes go line by line over all
documents of a batch at once. Features are worked out block of lines by block of lines, and a long chain is
swept in blocks side by side, so that a text of millions of lines takes some hundred bytes a line and a few
thousand steps; a single line is held whole.

Defined cases: null and empty texts are one empty line and get a score as well; rows without a usable
label teach nothing; a document with several labels counts as its lowest; if one of the two labels has
no rows, every score is the share of good labels (0.5 without any). Repeated rows get equal scores; no
rows, no result. Language, source, ids and other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gazette.llm.common import texts

SAMPLE_DOCS, SAMPLE_LINES = 1500, 48
STEPS, RATE, RIDGE = 400, 0.05, 1e-3

#: Kinds of bytes: letters (with all non-ASCII bytes), capitals, digits, white space, sentence marks, other marks.
LETTER, CAPITAL, DIGIT, SPACE, STOP, MARK = range(6)
KINDS = 6

#: Bytes of lines whose features are held at once, lines of texts that are passed together, lines from which a chain is cut.
BLOCK_BYTES, BATCH_LINES, LONG = 1 << 19, 1 << 17, 4096


def kinds() -> np.ndarray:
    table = np.full(256, MARK, dtype=np.uint8)
    table[128:] = LETTER
    for chars, kind in (
        (range(ord("a"), ord("z") + 1), LETTER),
        (range(ord("A"), ord("Z") + 1), CAPITAL),
        (range(ord("0"), ord("9") + 1), DIGIT),
        (b" \t\r\x0b\x0c\n\x00", SPACE),
        (b".,;:?'", STOP),
    ):
        table[list(chars)] = kind
    return table


def line_repeats(lines: Iterator[bytes], n: int) -> np.ndarray:
    """How often each line occurs in its text, by a 64-bit hash; an empty line counts once."""
    keys = np.fromiter((xxhash.xxh3_64_intdigest(x) if x else 0 for x in lines), dtype=np.uint64, count=n)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(keys == 0, 1, counts[place.ravel()]).astype(np.float64)


def block_features(data: bytes, repeats: np.ndarray, total_lines: int, table: np.ndarray) -> np.ndarray:
    """Features of each line of `data`, some whole lines of a text of `total_lines`."""
    lines = data.split(b"\n")
    sizes = np.array([len(x) + 1 for x in lines], dtype=np.int64)
    n = len(lines)
    flat = table[np.frombuffer(data + b"\n", dtype=np.uint8)]
    line = np.repeat(np.arange(n), sizes)
    counts = np.bincount(line * KINDS + flat, minlength=n * KINDS).reshape(n, KINDS).astype(np.float64)
    counts[:, SPACE] -= 1  # the line end itself
    solid = flat != SPACE
    begins = solid & np.concatenate([[True], ~solid[:-1]])
    words = np.bincount(line[begins], minlength=n).astype(np.float64)
    same = np.concatenate([[False], (flat[1:] == MARK) & (flat[:-1] == MARK)])
    runs = np.bincount(line[same], minlength=n).astype(np.float64)
    # Words that end in a mark, that begin with a capital, that have two capitals in a row.
    ends = solid & np.concatenate([~solid[1:], [True]])
    marked = np.bincount(line[ends & (flat == MARK)], minlength=n).astype(np.float64)
    headed = np.bincount(line[begins & (flat == CAPITAL)], minlength=n).astype(np.float64)
    loud = np.concatenate([[False], (flat[1:] == CAPITAL) & (flat[:-1] == CAPITAL)])
    shouts = np.bincount(line[loud], minlength=n).astype(np.float64)
    split = [x.split() for x in lines]
    distinct = np.array([len(set(x)) for x in split], dtype=np.float64)
    longest = np.array([max(map(len, x), default=0) for x in split], dtype=np.float64)
    total = np.maximum(sizes - 1, 1).astype(np.float64)
    per_word = np.maximum(words, 1)
    return np.column_stack(
        [
            counts / total[:, None],
            np.log1p(total) / 5,
            np.log1p(words) / 4,
            (total - counts[:, SPACE]) / per_word / 10,
            np.log1p(longest) / 4,
            1 - distinct / per_word,
            np.log1p(words) / 4 * (1 - distinct / per_word),
            runs / total,
            marked / per_word,
            headed / per_word,
            shouts / total,
            np.log(repeats),
            (repeats > 1).astype(np.float64),
            words == 0,
            np.log1p(total_lines) / 5 * np.ones(n),
        ]
    )


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ends; the last one ends with the text."""
    return np.append(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), len(data))


def laid_out(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a text, where each line starts and ends, and how often each occurs."""
    data = text.encode()
    ends = line_ends(data)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return data, starts, ends, line_repeats((data[a:b] for a, b in zip(starts, ends, strict=True)), len(ends))


def blocks(text: str, table: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The features of a text's lines, block by block with the number of the first line.

    A block is whole lines of about `BLOCK_BYTES`; a longer line is a block of its own. Whatever the number
    of lines, only one block's features are held at a time.
    """
    data, starts, ends, repeats = laid_out(text)
    n, at = len(ends), 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, side="right")))
        yield at, block_features(data[starts[at] : ends[stop - 1]], repeats[at:stop], n, table)
        at = stop


def line_features(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line, and line lengths in bytes (with the line end)."""
    return np.vstack([x for _, x in blocks(text, table)]), line_sizes(text)


def line_sizes(text: str) -> np.ndarray:
    ends = line_ends(text.encode())
    return np.diff(ends, prepend=-1).astype(np.int64)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, whether there is one, and a constant."""
    n = len(own)
    none = np.zeros((1, own.shape[1]))
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    edge = np.zeros((n, 3))
    edge[0, 0] = edge[-1, 1] = 1
    edge[:, 2] = 1
    return np.hstack([own, before, after, edge])


def neighbouring_lines(text: str, most: int, table: np.ndarray) -> np.ndarray:
    """Features, with neighbours, of up to `most` lines in a row; where they start follows from the text."""
    data, starts, ends, repeats = laid_out(text)
    n = len(ends)
    start = (len(text) * 7919) % max(1, n - most + 1)
    low, high = max(0, start - 1), min(n, start + most + 1)
    own = block_features(data[starts[low] : ends[high - 1]], repeats[low:high], n, table)
    return with_neighbours(own)[start - low : start - low + most]


def marginals(unary: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """P(good) of each line by forward-backward; `unary` are the scores of good against bad."""
    out = [long_marginals(u, transitions) if len(u) > LONG else np.empty(0) for u in unary]
    order = sorted((i for i in range(len(unary)) if len(unary[i]) <= LONG), key=lambda i: -len(unary[i]))
    sizes = np.array([len(unary[i]) for i in order])
    group = 0
    while group < len(order):
        # Documents of like length go together, so that little of the matrix is empty.
        stop = group + max(1, int(np.searchsorted(-sizes[group:], -max(1, sizes[group] // 2), side="right")))
        p = padded_marginals([unary[i] for i in order[group:stop]], transitions)
        for row, i in enumerate(order[group:stop]):
            out[i] = p[row, : len(unary[i])]
        group = stop
    return out


def padded_marginals(unary: list[np.ndarray], transitions: np.ndarray) -> np.ndarray:
    _, _, forward, backward = chain(*padded(unary), transitions)
    return good_share(forward, backward)


def padded(unary: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, unary))
    scores, valid = np.zeros((len(unary), width)), np.zeros((len(unary), width), dtype=bool)
    for i, u in enumerate(unary):
        scores[i, : len(u)], valid[i, : len(u)] = u, True
    return scores, valid


def emissions(scores: np.ndarray) -> np.ndarray:
    """Weights of the two states at each place, the larger one 1."""
    clipped = np.clip(scores, -60, 60)
    return np.stack([np.exp(-np.maximum(clipped, 0)), np.exp(np.minimum(clipped, 0))], axis=-1)


def sweep(emit: np.ndarray, valid: np.ndarray, move: np.ndarray, entering: np.ndarray, leaving: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward weights of every row's places, from what enters its first place and leaves its last.

    Rows are scaled at every place, so long documents neither under- nor overflow. Behind its valid places
    a row stands still.
    """
    rows, width = valid.shape
    forward, backward = np.empty((rows, width, 2)), np.empty((rows, width, 2))
    forward[:, 0] = entering * emit[:, 0]
    forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, width):
        step = forward[:, t - 1] @ move * emit[:, t]
        step /= step.sum(axis=1, keepdims=True)
        forward[:, t] = np.where(valid[:, t, None], step, forward[:, t - 1])
    backward[:, -1] = leaving
    for t in range(width - 2, -1, -1):
        step = (backward[:, t + 1] * emit[:, t + 1]) @ move.T
        step /= step.sum(axis=1, keepdims=True)
        backward[:, t] = np.where(valid[:, t + 1, None], step, leaving)
    return forward, backward


def good_share(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    good = forward[..., 1] * backward[..., 1]
    return good / (forward[..., 0] * backward[..., 0] + good)


def chain(scores: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> tuple:
    """Emissions, moves, and forward and backward weights of whole documents, one a row. States: 0 bad, 1 good."""
    emit = emissions(scores)
    emit[~valid] = 1
    move = np.exp(transitions - transitions.max())
    ends = np.ones((len(scores), 2))
    return emit, move, *sweep(emit, valid, move, ends, ends)


def passes(scores: np.ndarray, valid: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of good, and the marginals of neighbouring states summed over all places (for fitting)."""
    rows, width = scores.shape
    emit, move, forward, backward = chain(scores, valid, transitions)
    pairs = np.zeros((rows, 2, 2))
    for t in range(1, width):
        both = forward[:, t - 1, :, None] * move[None] * (backward[:, t] * emit[:, t])[:, None, :]
        both /= both.sum(axis=(1, 2), keepdims=True)
        pairs += np.where(valid[:, t, None, None], both, 0.0)
    return good_share(forward, backward), pairs


def long_marginals(unary: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(good) of each line of one long document.

    The chain is cut into as many blocks as a block has lines. The steps of a block multiply to one two by two
    matrix, for all blocks at once; from these follow the weights that enter and leave each block,
    and then all blocks are swept side by side. The result is that of one pass over the whole chain.
    """
    n = len(unary)
    width = max(2, int(np.ceil(np.sqrt(n))))
    rows = -(-n // width)
    scores, valid = np.zeros(rows * width), np.zeros(rows * width, dtype=bool)
    scores[:n], valid[:n] = unary, True
    scores, valid = scores.reshape(rows, width), valid.reshape(rows, width)
    emit = emissions(scores)
    emit[~valid] = 1
    move = np.exp(transitions - transitions.max())
    whole = np.tile(np.eye(2), (rows, 1, 1))
    for t in range(width):
        step = whole @ (move[None] * emit[:, t, None, :])
        if t == 0:
            step[0] = np.diag(emit[0, 0])  # nothing moves into the first line
        step /= step.sum(axis=(1, 2), keepdims=True)
        whole = np.where(valid[:, t, None, None], step, whole)
    entering, leaving = np.ones((rows, 2)), np.ones((rows, 2))
    end = np.ones(2)
    for k in range(rows - 1):
        end = end @ whole[k]
        end /= end.sum()
        entering[k + 1] = end @ move
    for k in range(rows - 2, -1, -1):
        back = whole[k + 1] @ leaving[k + 1]
        leaving[k] = back / back.sum()
    return good_share(*sweep(emit, valid, move, entering, leaving)).ravel()[:n]


def learn(documents: list[tuple[np.ndarray, int]], shares: dict[int, float], prior: float) -> tuple:
    """Weights by gradient ascent (Adam) on the likelihood of the lines' labels."""
    if len({label for _, label in documents}) < 2:
        return None, None, None, None, prior
    every = np.vstack([x for x, _ in documents])
    mean, spread = every.mean(axis=0), every.std(axis=0)
    mean, spread = np.where(spread > 0, mean, 0.0), np.where(spread > 0, spread, 1.0)
    width = max(len(x) for x, _ in documents)
    n, f = len(documents), every.shape[1]
    x = np.zeros((n, width, f), dtype=np.float32)
    valid = np.zeros((n, width), dtype=bool)
    for i, (features, _) in enumerate(documents):
        x[i, : len(features)], valid[i, : len(features)] = (features - mean) / spread, True
    labels = np.array([label for _, label in documents])
    weight = np.array([shares[label] for label in labels])
    weight = weight / (weight * valid.sum(axis=1)).sum()
    theta = np.zeros(f + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.maximum(valid.sum(axis=1) - 1, 0)
    for step in range(1, STEPS + 1):
        transitions = theta[f:].reshape(2, 2)
        good, pairs = passes(x @ theta[:f].astype(np.float32), valid, transitions)
        error = np.where(valid, labels[:, None] - good, 0.0) * weight[:, None]
        seen = np.zeros((n, 2, 2))
        seen[np.arange(n), labels, labels] = inner
        gradient = np.concatenate([np.einsum("nt,ntf->f", error.astype(np.float32), x), ((seen - pairs) * weight[:, None, None]).sum(axis=0).ravel()])
        gradient -= RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        theta = theta + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return mean, spread, theta[:f], theta[f:].reshape(2, 2), prior


def line_scores(text: str, model: tuple, table: np.ndarray) -> np.ndarray:
    """The score of good against bad of each line, from its own features and those of its neighbours.

    Of each block only three numbers a line stay: what its features add to its own score, and to those of
    the lines after and before it.
    """
    mean, spread, weights, _, _ = model
    scaled = weights / spread
    width = (len(weights) - 3) // 3
    own, before, after = (scaled[i * width : (i + 1) * width] for i in range(3))
    first, last, constant = scaled[3 * width :]
    parts = [x @ np.column_stack([own, before, after]) for _, x in blocks(text, table)]
    adds = np.vstack(parts)
    out = adds[:, 0] + (constant - mean @ scaled)
    out[1:] += adds[:-1, 1]
    out[:-1] += adds[1:, 2]
    out[0] += first
    out[-1] += last
    return out


def score_texts(batch: list[str], model: tuple, table: np.ndarray) -> np.ndarray:
    """The score of every text; texts go through the passes together up to `BATCH_LINES` lines."""
    transitions, prior = model[3], model[4]
    if transitions is None:
        return np.full(len(batch), prior)
    out, unary, sizes, held = [], [], [], 0

    def weigh() -> None:
        out.extend(float(p @ s / s.sum()) for p, s in zip(marginals(unary, transitions), sizes, strict=True))
        unary.clear()
        sizes.clear()

    for text in batch:
        unary.append(line_scores(text, model, table))
        sizes.append(line_sizes(text))
        held += len(sizes[-1])
        if held > BATCH_LINES:
            weigh()
            held = 0
    weigh()
    return np.array(out, dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> tuple:
    """The model learned from `labels` (doc_id, label 0 or 1), as a tuple of small arrays."""
    one = labels.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["count"] for r in one.groupBy("label").count().collect()}
    prior = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
    first = lambda label: one.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = first(0).unionByName(first(1))  # at most twice `sample_docs` rows: broadcast
    wanted = texts(docs, "doc_id").join(F.broadcast(sample), "doc_id").select("label", "text")
    table = kinds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                found.append(neighbouring_lines(text, sample_lines, table).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("label").cast(pa.int32()), pa.array(found, pa.binary())], names=["label", "features"])

    rows = sorted((r["label"], bytes(r["features"])) for r in wanted.mapInArrow(run, "label int, features binary").collect())
    width = with_neighbours(line_features("", table)[0]).shape[1]
    documents = [(np.frombuffer(x, "<f4").reshape(-1, width).astype(np.float64), label) for label, x in rows]
    held = {label: sum(1 for x, _ in rows if x == label) for label in (0, 1)}
    shares = {label: totals.get(label, 0) / held[label] for label in (0, 1) if held[label]}
    return learn(documents, shares, prior)


def score(docs: DataFrame, model: tuple, keep: list[str | Column] | None = None, name: str = "score") -> DataFrame:
    """The columns `keep` (by default doc_id) of every document and its score under `name`."""
    table = kinds()
    kept = docs.select(*(keep or ["doc_id"]))
    names = kept.columns
    slim = kept if "text" in names else docs.select(*(keep or ["doc_id"]), F.col("text").alias("_text"))
    at = names.index("text") if "text" in names else len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = score_texts([t or "" for t in batch.column(at).to_pylist()], model, table)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores)], names=[*names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return slim.mapInArrow(run, f"{schema}, `{name}` double")
