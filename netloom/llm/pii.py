"""Personal details in free text: weak labelers vote on spans, their reliabilities are estimated, a classifier decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from netloom.llm.pii_spans import CLASSES, Names, spans
from netloom.session import materialize

#: Names of a list that goes to the tasks; a longer one is refused, as it would have to be joined.
MOST_NAMES = 1_000_000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person": "[PERSON]"}
ROUNDS = 200
#: What the first guess gives the classes with most votes.
FIRST_GUESS = 0.9
_SPAN = "struct<first:int,last:int,sort:string,votes:string,shape:string,pii_text:string>"


def _names(names: DataFrame) -> list[tuple[str, str]]:
    rows: list[Row] = names.select("name", "name_kind").dropna().distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return sorted((r.name, r.name_kind) for r in rows)


def candidate_spans(documents: DataFrame, names: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, and every span of the text that may be a detail with the labelers' votes and its shape. Nothing is shuffled.

    With ``keep_text`` there is a row for each document, with its text; otherwise only those with spans have one.
    """
    spark, key = documents.sparkSession, dict(documents.dtypes)["doc_id"]
    sent = spark.sparkContext.broadcast(_names(names))
    schema = f"doc_id {key}, {'text string, ' if keep_text else ''}spans array<{_SPAN}>"
    kind = to_arrow_schema(StructType.fromDDL(schema)).field("spans").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Names(sent.value)
        for b in batches:
            found = [[{"first": s.start, "last": s.end, "sort": s.sort, "votes": s.votes, "shape": s.shape, "pii_text": t[s.start : s.end]} for s in spans(t, known)] if t else [] for t in b.column("text").to_pylist()]
            if keep_text:
                yield pa.record_batch([b.column("doc_id"), b.column("text"), pa.array(found, kind)], names=["doc_id", "text", "spans"])
            else:
                at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
                yield pa.record_batch([b.column("doc_id").take(at), pa.array([f for f in found if f], kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, schema)


def majority(votes: np.ndarray, classes: int) -> np.ndarray:
    """First guess of each pattern's class: the class with most votes, several sharing; -1 is no vote."""
    n = np.stack([(votes == c).sum(axis=1) for c in range(classes)], axis=1)
    top = (n == n.max(axis=1, keepdims=True)).astype(float)
    return FIRST_GUESS * top / top.sum(axis=1, keepdims=True) + (1 - FIRST_GUESS) / classes


def estimate(votes: np.ndarray, counts: np.ndarray, classes: int = 2, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over patterns of votes (a class, or -1 for none) and how often each occurs.

    Returns the probability of each pattern to be of each class and, by labeler, vote and class, the estimated share of the
    vote among that class. It starts from the majority and takes labelers as independent given the class.
    """
    q = majority(votes, classes)
    one_hot = np.stack([votes == v for v in range(-1, classes)], axis=2).astype(float)  # pattern, labeler, vote
    for _ in range(rounds):
        w = q * counts[:, None]
        prior = (w.sum(axis=0) + 1) / (w.sum() + classes)
        table = np.einsum("pkv,pc->kvc", one_hot, w) + 0.5
        share = table / table.sum(axis=1, keepdims=True)
        score = np.log(prior)[None, :] + np.einsum("pkv,kvc->pc", one_hot, np.log(share))
        new = np.exp(score - score.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-9:
            break
    return q, share


def train(x: np.ndarray, q: np.ndarray, counts: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression over several classes on soft labels, by Newton's method with halved steps."""
    n, d = x.shape
    c = q.shape[1]
    w = np.zeros((d, c))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x @ w
        z -= z.max(axis=1, keepdims=True)
        logp = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        return float(-(counts[:, None] * q * logp).sum() + ridge / 2 * (w**2).sum()), np.exp(logp)

    now, p = loss(w)
    for _ in range(60):
        grad = x.T @ (counts[:, None] * (p - q)) + ridge * w
        hess = np.einsum("ni,nab,nj->iajb", x, counts[:, None, None] * (p[:, :, None] * np.eye(c) - p[:, :, None] * p[:, None, :]), x).reshape(d * c, d * c) + ridge * np.eye(d * c)
        step = np.linalg.solve(hess, grad.ravel()).reshape(d, c)
        size = 1.0
        while size > 1e-6 and loss(w - size * step)[0] > now:
            size /= 2
        w = w - size * step
        before, (now, p) = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def decide(patterns: list[Row]) -> list[tuple[str, str, str, str, float]]:
    """Class and its probability of each pattern (sort, votes, shape, n): labels come from ``estimate``, answers from the
    classifier that ``train`` fits to them, whose features are the votes and the shapes."""
    out = []
    for sort, classes in CLASSES.items():
        rows = sorted((r for r in patterns if r.sort == sort), key=lambda r: (r.votes, r.shape))
        if not rows:
            continue
        votes = np.array([["-0123".index(c) - 1 for c in r.votes] for r in rows])
        counts = np.array([r.n for r in rows], float)
        q, _ = estimate(votes, counts, len(classes))
        shapes = sorted({r.shape for r in rows})
        x = np.concatenate([np.ones((len(rows), 1)), *[votes == v for v in range(len(classes))], np.array([[r.shape == f for f in shapes] for r in rows])], axis=1).astype(float)
        z = x @ train(x, q, counts)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        out += [(sort, r.votes, r.shape, classes[int(k)], float(v[k])) for r, v, k in zip(rows, p, p.argmax(axis=1), strict=True)]
    return out


def _decisions(found: DataFrame) -> list[tuple[str, str, str, str, float]]:
    # Patterns are few whatever the corpus: votes of at most eight labelers, and shapes by numbers of digits and groups.
    patterns = found.select(F.explode("spans").alias("s")).groupBy("s.sort", "s.votes", "s.shape").agg(F.count(F.lit(1)).alias("n")).collect()
    return [d for d in decide(patterns) if d[3] != "none"]


def personal_details(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id, kind, first, last, pii_text of every span that the classifier takes for a personal detail.

    ``first`` and ``last`` are code points of the text as it stands. Labelers read all texts, whole; their reliabilities and
    the classifier are fitted on the counts of all vote patterns. Null and empty texts have no details; rows with a null
    doc_id keep it, which may be of any type; repeated rows give repeated details; an empty table gives none; other columns
    may have any name.
    """
    found = materialize(candidate_spans(documents, names), "pii")
    rules = documents.sparkSession.createDataFrame(_decisions(found), "sort string, votes string, shape string, kind string, p double")
    each = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")
    return each.join(F.broadcast(rules), ["sort", "votes", "shape"]).select("doc_id", "kind", "first", "last", "pii_text")


def mask(documents: DataFrame, names: DataFrame) -> DataFrame:
    """doc_id and text of every row, each detail replaced by a placeholder of its kind; the rest stays as it is.

    Texts are labeled once and written with their spans; the replacing pass reads these, and needs the decisions on the
    patterns only, a bounded table, so no text is shuffled.
    """
    found = materialize(candidate_spans(documents, names, keep_text=True), "pii")
    rules = {d[:3]: (PLACEHOLDER[d[3]], d[4]) for d in _decisions(found)}
    sent = documents.sparkSession.sparkContext.broadcast(rules)

    def masked(text: str | None, found: list[dict]) -> str | None:
        hits = sorted((s["first"], -rules_[1], s["last"], rules_[0]) for s in found if (rules_ := sent.value.get((s["sort"], s["votes"], s["shape"]))))
        if not hits:
            return text
        out, at = [], 0
        for start, _, end, placeholder in hits:
            if start >= at:
                out += [text[at:start], placeholder]
                at = end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, s) for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, text string")
