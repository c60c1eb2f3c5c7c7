"""Grounded answering over a table of questions.

Hits come from the top-k scan (one row per question and rank). Everything
here is grouped by ``query_id`` with lists bounded by k <= 50, or is a
row-local expression; chat histories are windows per conversation.
"""

from __future__ import annotations

import re
import time

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docsearch_spark.functions.text import CITATION_PATTERN, col_, or_empty, py_strip

# Fixed values that must equal the application being re-built: the prompt
# templates, the source separator and the empty-context answer.
SYSTEM_PROMPT = (
    "You are a careful assistant. Ground every factual claim in the provided sources using [S#] citations. "
    "Do not invent facts not present in sources."
)
USER_TEMPLATE = (
    "Question: %s\n"
    "\n"
    "Use ONLY the sources below. If the answer is not in the sources, say you cannot find it in the documents.\n"
    "\n"
    "Sources:\n"
    "%s\n"
    "\n"
    "Answer concisely. After each sentence or claim that uses a source, add a citation like [S1] or [S2] "
    "matching the source label."
)
SOURCE_SEPARATOR = "\n\n---\n\n"
NO_CONTEXT_ANSWER = "No retrieved context. Ingest documents first."


def source_label(rank) -> Column:
    """G1: the i-th retrieved chunk is ``S{i}``."""
    return F.concat(F.lit("S"), col_(rank).cast("string"))


def source_line(hits_rank="rank", chunk_id="chunk_id", source_path="source_path", content="content") -> Column:
    return F.concat(F.lit("["), source_label(hits_rank), F.lit("] (chunk_id="), col_(chunk_id),
                    F.lit(", file="), col_(source_path), F.lit(")\n"), col_(content))


def build_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, system, user, n_sources) for every question with hits.

    ``hits``: (query_id, rank, chunk_id, source_path, content). The per-question
    list holds at most k <= 50 sources.
    """
    blocks = (hits.groupBy("query_id")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"),
                                                        source_line().alias("line")))).alias("src"))
              .select("query_id",
                      F.array_join(F.transform("src", lambda x: x["line"]), SOURCE_SEPARATOR).alias("block"),
                      F.size("src").alias("n_sources")))
    q = questions.select("query_id", "question")
    return q.join(blocks, "query_id").select(
        "query_id", F.lit(SYSTEM_PROMPT).alias("system"),
        F.format_string(USER_TEMPLATE, or_empty("question"), F.col("block")).alias("user"),
        F.col("n_sources").cast("int").alias("n_sources"))


# --------------------------------------------------------------------------
# Answer stage


def first_sentence(text) -> Column:
    s = F.regexp_extract(or_empty(text), r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(F.length(s) > 0, s).otherwise(or_empty(text))


def extractive_answers(hits: DataFrame) -> DataFrame:
    """Default answer provider (deterministic, no model): the first sentence of
    source 1 followed by `` [S1]``."""
    top = hits.filter(F.col("rank") == 1)
    return top.select("query_id", py_strip(F.concat(first_sentence("content"), F.lit(" [S1]"))).alias("answer"))


class AnswerProvider:
    """A chat model: ``answer(system, user) -> str | None``; created inside tasks."""

    name = "abstract"

    def answer(self, system: str, user: str):  # pragma: no cover - interface
        raise NotImplementedError


class CountingProvider(AnswerProvider):
    """A deterministic provider for checks: tells the prompt's length and cites its
    last and first source, and one that is not there."""

    name = "counting"

    def answer(self, system: str, user: str) -> str:
        if system != SYSTEM_PROMPT:
            raise ValueError("unexpected system prompt")
        n = max(int(x) for x in re.findall(r"^\[S(\d+)\] \(chunk_id=", user, re.M))
        return f"  Read {len(user)} characters, {n} sources [S{n}] [S1] [S0]. "


def answers_with_provider(prompts: DataFrame, provider_factory) -> DataFrame:
    """G4 through an external model (``mapInArrow``): the reply is stripped and a
    missing reply becomes ''."""
    schema = T.StructType([T.StructField("query_id", prompts.schema["query_id"].dataType),
                           T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prov = provider_factory()
        for rb in batches:
            qs = rb.column("query_id")
            out = [(prov.answer(s, u) or "").strip()
                   for s, u in zip(rb.column("system").to_pylist(), rb.column("user").to_pylist())]
            yield pa.RecordBatch.from_arrays([qs, pa.array(out, type=pa.string())], names=["query_id", "answer"])

    return prompts.select("query_id", "system", "user").mapInArrow(run, schema)


def answers_or_errors(prompts: DataFrame, provider_factory, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """G4 with failures as rows: (query_id, answer, attempts, error).

    A call that raises is tried again, up to ``attempts`` calls, after ``wait`` seconds and
    twice as long each time. A prompt whose calls all raise has a null answer and the last
    error's text; the other prompts of the job are not lost with it. Rows of
    ``error IS NOT NULL`` can be asked again later.
    """
    if attempts < 1:
        raise ValueError("attempts must be at least 1")
    schema = T.StructType([T.StructField("query_id", prompts.schema["query_id"].dataType),
                           T.StructField("answer", T.StringType()),
                           T.StructField("attempts", T.IntegerType()),
                           T.StructField("error", T.StringType())])

    def ask(prov, system: str, user: str):
        for n in range(1, attempts + 1):
            try:
                return (prov.answer(system, user) or "").strip(), n, None
            except Exception as e:  # a provider may raise anything
                error = f"{type(e).__name__}: {e}"
                if n < attempts:
                    time.sleep(wait * 2 ** (n - 1))
        return None, attempts, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prov = provider_factory()
        for rb in batches:
            got = [ask(prov, s, u) for s, u in zip(rb.column("system").to_pylist(), rb.column("user").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [rb.column("query_id"), pa.array([g[0] for g in got], pa.string()),
                 pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.string())],
                names=schema.names)

    return prompts.select("query_id", "system", "user").mapInArrow(run, schema)


# --------------------------------------------------------------------------
# G5-G8


def citation_labels(answer) -> Column:
    """Distinct digit groups of ``[S<digits>]`` in the answer."""
    return F.array_distinct(F.regexp_extract_all(or_empty(answer), F.lit(CITATION_PATTERN), 1))


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Labels in numeric order, matched as text to ``S{rank}``; unmatched
    labels (``[S0]``, ``[S01]``, beyond k) are dropped.

    Returns (query_id, cite_pos INT, chunk_id, doc_id, source_path), cite_pos
    counting the resolved citations from 1.
    """
    labs = answers.select("query_id", F.explode(citation_labels("answer")).alias("lab"))
    h = hits.select("query_id", source_label("rank").alias("label"), "chunk_id", "doc_id", "source_path")
    j = labs.join(h, (labs["query_id"] == h["query_id"]) &
                  (F.concat(F.lit("S"), labs["lab"]) == h["label"])).drop(h["query_id"])
    w = Window.partitionBy("query_id").orderBy(F.col("lab").cast("decimal(38,0)"), F.col("lab"))
    return j.select("query_id", F.row_number().over(w).cast("int").alias("cite_pos"),
                    "chunk_id", "doc_id", "source_path")


def citation_lines(citations: DataFrame) -> DataFrame:
    """``  - {chunk_id} ({source_path})`` per citation, in order."""
    return citations.select("query_id", F.col("cite_pos").alias("line_no"),
                            F.format_string("  - %s (%s)", "chunk_id", "source_path").alias("line"))


def assemble_responses(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """G3 + G7: one nested response per question.

    Questions without hits get the fixed no-context answer and empty lists.
    """
    cites = resolve_citations(answers, hits)
    c = (cites.groupBy("query_id")
         .agg(F.array_sort(F.collect_list(F.struct("cite_pos", "chunk_id", "doc_id", "source_path"))).alias("c"))
         .select("query_id",
                 F.transform("c", lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["doc_id"].alias("doc_id"),
                                                     x["source_path"].alias("source_path"))).alias("citations"),
                 F.transform("c", lambda x: x["chunk_id"]).alias("raw_citation_ids")))
    r = (hits.groupBy("query_id")
         .agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "source_path", "chunk_index",
                                                   "content", "score"))).alias("h"))
         .select("query_id", F.transform("h", lambda x: F.struct(
             x["chunk_id"].alias("chunk_id"), x["doc_id"].alias("doc_id"), x["source_path"].alias("source_path"),
             x["chunk_index"].alias("chunk_index"), x["content"].alias("content"),
             x["score"].alias("score"))).alias("retrieved")))
    q = questions.select("query_id")
    j = q.join(r, "query_id", "left").join(answers, "query_id", "left").join(c, "query_id", "left")
    has = F.col("retrieved").isNotNull()
    return j.select(
        "query_id",
        F.when(has, or_empty("answer")).otherwise(F.lit(NO_CONTEXT_ANSWER)).alias("answer"),
        F.when(has, F.coalesce("citations", F.array().cast(
            "array<struct<chunk_id:string,doc_id:string,source_path:string>>"))).otherwise(F.array().cast(
                "array<struct<chunk_id:string,doc_id:string,source_path:string>>")).alias("citations"),
        F.coalesce("retrieved", F.array().cast(r.schema["retrieved"].dataType)).alias("retrieved"),
        F.when(has, F.coalesce("raw_citation_ids", F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>")).alias("raw_citation_ids"))


# --------------------------------------------------------------------------
# G9, A3


def chat_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """G9 in the form to store: (pairs, turns), both linear in the conversation.

    pairs: (conv_id, pairs ARRAY<STRUCT<question, answer>>), one ordered list a
    conversation; turns: (conv_id, turn, question, n_history), a user turn's
    history being the first ``n_history`` pairs. System turns are dropped; a pair is
    a user turn directly followed by an assistant turn.
    """
    c = conversations.filter(F.col("role") != "system")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = (c.withColumn("next_role", F.lead("role").over(w))
              .withColumn("next_text", F.lead("text").over(w))
              .filter(F.col("role") == "user")
              .withColumn("is_pair", F.coalesce(F.col("next_role") == "assistant", F.lit(False))))
    turns = paired.select("conv_id", "turn", F.col("text").alias("question"), F.coalesce(
        F.sum(F.col("is_pair").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).cast("int").alias("n_history"))
    pairs = (paired.filter("is_pair").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("turn").alias("t"), F.col("text").alias("question"), F.col("next_text").alias("answer")))).alias("p"))
        .select("conv_id", F.transform("p", lambda x: F.struct(
            x["question"].alias("question"), x["answer"].alias("answer"))).alias("pairs")))
    return pairs, turns


def chat_history(conversations: DataFrame) -> DataFrame:
    """For each user turn, the earlier (question, answer) pairs of the conversation,
    sliced from the stored list. (conv_id, turn, question, history)."""
    pairs, turns = chat_turns(conversations)
    none = F.array().cast(pairs.schema["pairs"].dataType)
    return turns.join(pairs, "conv_id", "left").select(
        "conv_id", "turn", "question",
        F.when(F.col("n_history") > 0, F.slice("pairs", F.lit(1), F.col("n_history"))).otherwise(none).alias("history"))


def assemble_fragments(frags: DataFrame, doc_col: str, part_col: str, text_col: str,
                       sep: str = "\n") -> DataFrame:
    """A3: ordered fragments of one document joined with ``sep``; a missing
    fragment counts as ''. (doc, text)."""
    return (frags.groupBy(doc_col)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(part_col).alias("p"),
                                                      or_empty(text_col).alias("t")))).alias("parts"))
            .select(doc_col, F.array_join(F.transform("parts", lambda x: x["t"]), sep).alias("text")))
