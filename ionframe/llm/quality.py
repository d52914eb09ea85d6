"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, only, stored

FEATURES = 16
_RUN = re.compile(r"(.)\1{3,}")
_DOUBLED = re.compile(r"[^\w\s]{2,}")


def line_features(line: str) -> list[float]:
    """Numbers about one line, each about 0 to 1, whatever its length."""
    n = len(line)
    words = line.split()
    if not words:
        return [1.0, 1.0] + [0.0] * (FEATURES - 2)
    k = len(words)
    packed = "".join(words)
    m = len(packed)
    alpha = sum(map(str.isalpha, packed))
    upper = sum(map(str.isupper, packed))
    digits = sum(map(str.isdigit, packed))
    symbols = len(re.findall(r"[^\w\s.,;:!?'\"()-]", packed))
    doubled = _DOUBLED.findall(packed)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        1.0,
        0.0,
        min(1.0, np.log1p(n) / 8),
        min(1.0, m / k / 12),
        alpha / m,
        upper / max(1, alpha),
        digits / m,
        symbols / m,
        min(1.0, len(doubled) / k),
        repeats / k,
        len(set(words)) / k if k > 3 else 1.0,
        sum(len(w) == 1 for w in words) / k,
        float(words[-1][-1] in ".!?…"),
        float(words[0][0].isupper()),
        float(bool(_RUN.search(line))),
        sum(not w[0].isalnum() for w in words) / k,
    ]


def _with_neighbours(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A line's features, then those of the line before and after it (zeros beyond the text)."""
    starts = np.cumsum(sizes) - sizes
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[starts] = 0
    after[starts + sizes - 1] = 0
    return np.hstack([x, before, after])


def marginals(unary: np.ndarray, link: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label) of each line by forward-backward, and the summed P(label, next label).

    unary: lines x 2 scores; link: 2 x 2 scores of neighbouring labels; sizes: lines per text.
    Texts advance together, one line a step, longest first, so a step costs one array operation.
    """
    order = np.argsort(-sizes, kind="stable")
    starts, long = (np.cumsum(sizes) - sizes)[order], sizes[order]
    local = np.exp(unary - unary.max(1, keepdims=True))
    e = np.exp(link - link.max())
    steps = int(long[0]) if len(long) else 0
    active = np.searchsorted(-long, -np.arange(steps), side="left")
    fwd = np.empty_like(local)
    at = np.empty((len(long), 2))
    for t in range(steps):
        rows = starts[: active[t]] + t
        now = local[rows] if t == 0 else (at[: active[t]] @ e) * local[rows]
        at[: active[t]] = fwd[rows] = now / now.sum(1, keepdims=True)
    out = np.empty_like(local)
    back = np.ones((len(long), 2))
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, -1, -1):
        rows = starts[: active[t]] + t
        more = active[t + 1] if t + 1 < steps else 0
        if more:
            nxt = local[starts[:more] + t + 1] * back[:more]
            joint = fwd[rows[:more]][:, :, None] * e[None] * nxt[:, None, :]
            pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            new = nxt @ e.T
            back[:more] = new / new.sum(1, keepdims=True)
        p = fwd[rows] * back[: active[t]]
        out[rows] = p / p.sum(1, keepdims=True)
    return out, pairs


def fit(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, weights: np.ndarray, steps: int = 250, ridge: float = 1e-4) -> dict:
    """Weights of the field by Adam on the conditional log-likelihood of the lines' labels, then a
    logistic fit of the documents' labels on the logit of their length-weighted marginals."""
    full = _with_neighbours(x, sizes)
    w, link = np.zeros((full.shape[1], 2)), np.zeros((2, 2))
    hot = np.eye(2)[y]
    ends = np.cumsum(sizes) - 1
    inner = np.setdiff1d(np.arange(len(y)), ends)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner], y[np.minimum(inner + 1, len(y) - 1)]), 1)
    m = [np.zeros_like(w), np.zeros_like(link)]
    v = [np.zeros_like(w), np.zeros_like(link)]
    for i in range(1, steps + 1):
        p, pairs = marginals(full @ w, link, sizes)
        grads = [full.T @ (p - hot) / len(y) + ridge * w, (pairs - seen) / len(y) + ridge * link]
        for k, (theta, g) in enumerate(zip((w, link), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            theta -= 0.1 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    model = {"w": w, "link": link, "a": 1.0, "b": 0.0}
    doc = _logit(_weighted(marginals(full @ w, link, sizes)[0][:, 1], weights, sizes))
    target = y[np.cumsum(sizes) - 1].astype(float)
    a = b = 0.0
    for _ in range(60):  # Newton steps of a two-parameter logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * doc + b, -30, 30)))
        s = p * (1 - p) + 1e-6
        h = np.array([[np.sum(s * doc * doc) + 1, np.sum(s * doc)], [np.sum(s * doc), np.sum(s) + 1]])
        step = np.linalg.solve(h, [np.sum((p - target) * doc) + a, np.sum(p - target) + b])
        a, b = a - step[0], b - step[1]
    return model | {"a": float(a), "b": float(b)}


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _weighted(p: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    return np.add.reduceat(p * weights, starts) / np.add.reduceat(weights, starts)


def _lines(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weights (length + 1) and lines per text; a null text is one empty line."""
    split = [(t or "").split("\n") for t in texts]
    sizes = np.array([len(s) for s in split])
    x = np.array([line_features(line) for s in split for line in s])
    weights = np.array([len(line) + 1.0 for s in split for line in s])
    return x, weights, sizes


def score_texts(texts: list, model: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document scores, and each line's P(good)."""
    x, weights, sizes = _lines(texts)
    p = marginals(_with_neighbours(x, sizes) @ model["w"], model["link"], sizes)[0][:, 1]
    doc = _logit(_weighted(p, weights, sizes))
    return 1 / (1 + np.exp(-np.clip(model["a"] * doc + model["b"], -30, 30))), np.split(p, np.cumsum(sizes)[:-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 6000, max_lines: int = 100) -> dict:
    """A model from a sample of about max_docs labelled documents (those with the smallest hashes
    of their ids). Of a text of more lines, max_lines neighbouring ones from a place set by the text's hash
    take part, so that max_docs * max_lines bounds the fit. Every line has its document's label. Only rows whose crc32(id as text) mod 3 is not 1 are used. Null ids or labels
    are ignored; an id with several labels has their rounded mean. Without labels of both
    kinds every document scores the share of good labels (0.5 without any)."""
    known = only(labels, doc_id=id_col, y=label_col).where("doc_id is not null and y is not null and crc32(cast(doc_id as string)) % 3 <> 1")
    known = known.groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
    n = known.count()
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(4)), F.lit(1 << 20))
    sample = stored(known.where(share < int(min(1.0, max_docs / max(n, 1)) * (1 << 20)) + 1), "labelled")

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                rows = [(y, (t or "").split("\n")) for y, t in zip(part.column("y").to_pylist(), part.column("text").to_pylist(), strict=True)]
                starts = [xxhash.xxh3_64_intdigest("\n".join(ls)) % max(1, len(ls) - max_lines + 1) for _, ls in rows]
                rows = [(y, ls[at : at + max_lines]) for (y, ls), at in zip(rows, starts, strict=True)]
                flat = [np.array([line_features(x) + [len(x) + 1.0] for x in ls], np.float32).ravel() for _, ls in rows]
                yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array(flat, pa.list_(pa.float32()))], names=["y", "x"])

    texts = only(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id").select("y", "text")  # bounded by max_docs
    got = texts.mapInArrow(run, "y int, x array<float>").toArrow()
    ys = np.array(got["y"].to_pylist(), int)
    if len(set(ys.tolist())) < 2:
        p = float(np.clip(ys.mean() if len(ys) else 0.5, 1e-3, 1 - 1e-3))
        return {"w": np.zeros((3 * FEATURES, 2)), "link": np.zeros((2, 2)), "a": 0.0, "b": float(np.log(p / (1 - p)))}
    parts = [np.array(r, np.float64).reshape(-1, FEATURES + 1) for r in got["x"].to_pylist()]
    order = sorted(range(len(parts)), key=lambda i: (len(parts[i]), parts[i].tobytes(), ys[i]))  # the same model however rows arrive
    sizes = np.array([len(parts[i]) for i in order])
    x = np.vstack([parts[i] for i in order])
    return fit(x[:, :-1], np.repeat(ys[order], sizes), sizes, x[:, -1])


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with score (P(good), 0 to 1), predicted (1 at threshold or above), n_lines and n_bad_lines.

    A null or empty text is scored as one empty line. Texts of any length are scored whole; every
    row is scored by its own, so ties, repeated rows and null ids need no rule. Columns of docs stay; those of
    the same names as the new ones give way. Empty input gives no rows.
    """
    new = ["score", "predicted", "n_lines", "n_bad_lines"]
    rest = docs.drop(*new)
    at = rest.columns.index(text_col)
    plain = rest.toDF(*[f"c{i}" for i in range(len(rest.columns))])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields) + ", score double, predicted int, n_lines long, n_bad_lines long"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, f"c{at}"):
                scores, lines = score_texts(part.column(at).to_pylist(), model)
                cols = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32)), pa.array([len(p) for p in lines], pa.int64()), pa.array([int((p < 0.5).sum()) for p in lines], pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, *new])

    return plain.mapInArrow(run, schema).toDF(*rest.columns, *new)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines of every row of docs; held_out is
    true where crc32(doc_id as text) mod 3 is 1 (false for a null id)."""
    model = train(docs, labels)
    out = classify(only(docs, doc_id="doc_id", text="text"), model)
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs."""
    return classify(docs, train(docs, labels)).where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
