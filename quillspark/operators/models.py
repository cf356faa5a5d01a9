"""Steps around models that callers bring: embedding texts, asking for a route, merging what a session remembers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import strip, trim_text
from . import routing
from .vectors import normalized

#: Older names of tasks, and the task and prompt that they mean.
OLDER_TASKS = {"retrieval.query": ("retrieval", "query"), "retrieval.passage": ("retrieval", "document")}
Encoder = Callable[..., list[list[float]]]


def encode_options(task: str | None, prompt: str | None = None) -> dict[str, str]:
    """What a model is called with: task and prompt name where they are given; a prompt that is given keeps an older task's name."""
    task, prompt = (task or "").strip(), (prompt or "").strip()
    if not prompt and task in OLDER_TASKS:
        task, prompt = OLDER_TASKS[task]
    return {k: v for k, v in (("task", task), ("prompt_name", prompt)) if v}


def encoded(rows: DataFrame, text: str, load: Callable[[], Encoder], *, task: str | None = None, prompt: str | None = None, batch: int = 64, normalize: bool = True) -> DataFrame:
    """rows with `embedding`; the model is loaded once for each task and gets `batch` texts at a time, whichever documents they are of.

    Null texts are encoded as empty ones. A model that returns another number of vectors than it was given texts is an error. Extra
    columns stay; one named embedding is replaced.
    """
    rows = rows.drop("embedding")
    options = encode_options(task, prompt)
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                texts = [t or "" for t in part.column(at).to_pylist()]
                found = [[float(x) for x in v] for v in model(texts, **options)]
                if len(found) != len(texts):
                    raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.float64()))], names=[*part.schema.names, "embedding"])

    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))])
    out = rows.mapInArrow(run, schema)
    return out.withColumn("embedding", normalized(F.col("embedding"))) if normalize else out


def _or_none(text: Column) -> Column:
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "None").otherwise(text)


def route_request(scope: str, question: Column, previous: Column, history: Column, summary: Column, history_most: int = 3000, summary_most: int = 4000) -> Column:
    """The request to a model that chooses the route. scope: what the corpus is about, and how to answer; the rest within its budgets."""
    parts = {
        "Question": F.coalesce(question, F.lit("")),
        "Earlier route": _or_none(previous),
        "Conversation": _or_none(trim_text(history, min(history_most, 3000), "tail")),
        "Summary": _or_none(trim_text(summary, min(summary_most, 4000), "middle")),
    }
    return F.concat_ws("\n\n", F.lit(scope), *(F.concat(F.lit(f"{label}:\n"), c) for label, c in parts.items()))


def model_route(reply: Column) -> Column:
    """The route of a reply; null where the call failed (a null reply) or the reply holds no decision, so that the next rule speaks."""
    use = routing.verdict(reply)
    return F.when(use, "llm_rag").when(~use, "llm_direct")


def remembered(summary: Column, history: Column, reply: Column, most: int, history_most: int) -> Column:
    """A session's summary after a model was asked to merge `history` into it, at most `most` characters.

    Without history the old summary stays. Where the call failed (a null reply) the old summary and the history stand one below the other.
    """
    old = trim_text(summary, most)
    new = trim_text(history, history_most)
    nothing = F.coalesce(history, F.lit("")) == ""
    both = F.concat_ws("\n", F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))
    return F.when(nothing, old).when(reply.isNull(), trim_text(both, most)).otherwise(trim_text(reply, most))
