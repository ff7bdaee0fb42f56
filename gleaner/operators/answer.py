"""Prompts and extractive answers over ranked contexts, for many questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as tx
from gleaner.operators.sparse import DIGITS

BUDGET_CHARS = 12_000
ANSWER_SENTENCES = 4
LEAST_CHARS = 15
# Texts that callers compare with.
NO_ANSWER = "I don't have that in the indexed sources."
INSTRUCTION = "Answer using only the context above, with [n] citations."
SYSTEM = "Answer from the numbered context only and cite the numbers. Where the context doesn't hold the answer, say exactly: " + NO_ANSWER
BLOCK = "[Context %d]\nSource: %s\n%s\n"
TRUNCATED = "[Context truncated: %d further sources omitted]"
CONVERSATION, USER, ASSISTANT, QUESTION = "Conversation so far:\n", "User: ", "Assistant: ", "\nQuestion: "


@dataclass(frozen=True)
class Templates:
    """The texts of a prompt; any of them can be replaced."""

    system: str = SYSTEM
    instruction: str = INSTRUCTION
    block: str = BLOCK
    truncated: str = TRUNCATED


def context_blocks(hits: DataFrame, budget: int = BUDGET_CHARS, block_format: str = BLOCK) -> DataFrame:
    """(qid, position, source, block, kept): contexts in order; kept is true for the prefix within the budget."""
    block = F.format_string(block_format, F.col("position"), F.coalesce("source", F.lit("")), F.col("text"))
    rows = hits.select("qid", "position", "source", block.alias("block"))
    return rows.selectExpr("*", f"sum(length(block)) over (partition by qid order by position rows between unbounded preceding and current row) <= {budget} as kept")


def prompts(queries: DataFrame, hits: DataFrame, budget: int = BUDGET_CHARS, history: DataFrame | None = None, templates: Templates | None = None) -> DataFrame:
    """(qid, messages): a system and a user message for every query; history(qid, turn, role, text) gives its last four turns."""
    texts = templates or Templates()
    b = context_blocks(hits, budget, texts.block).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("position", "block")))).alias("blocks"), F.count_if(~F.col("kept")).alias("left_out")
    )
    sections = F.concat(F.transform(F.coalesce("blocks", F.array()), lambda x: x["block"]), F.when(F.coalesce("left_out", F.lit(0)) == 0, F.array()).otherwise(F.array(F.format_string(texts.truncated, "left_out"))))
    q = queries.select("qid", "query").join(b, "qid", "left")
    past = F.lit("")
    if history is not None:
        last = history_window(history, 4)
        said = last.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.when(F.col("role") == "user", USER).otherwise(ASSISTANT), F.col("text")).alias("line")))).alias("turns"))
        q = q.join(said, "qid", "left")
        past = F.coalesce(F.concat(F.lit(CONVERSATION), F.array_join(F.transform("turns", lambda t: t["line"]), "\n"), F.lit("\n\n")), F.lit(""))
    user = F.concat(past, F.array_join(sections, ""), F.lit(QUESTION), F.col("query"), F.lit("\n\n" + texts.instruction))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return q.select("qid", F.array(message("system", F.lit(texts.system)), message("user", user)).alias("messages"))


def history_window(turns: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation."""
    return turns.selectExpr("*", "row_number() over (partition by qid order by turn desc) as back").where(F.col("back") <= n).drop("back")


def answer_sentences(queries: DataFrame, hits: DataFrame, n: int = ANSWER_SENTENCES) -> DataFrame:
    """(qid, nth, position, source, sentence, score, citation): the best sentences over all contexts of each query.

    Sentences shorter than 15 characters, without tokens or without a query token don't count. Citations number the
    distinct sources in the order in which the chosen sentences first use them.
    """
    q = queries.select("qid", F.array_distinct(tx.tokens("query")).alias("q")).where("size(q) > 0")
    s = hits.select("qid", "position", "source", F.posexplode(tx.sentences(F.regexp_replace("text", "\n", " "))).alias("at", "sentence"))
    s = s.withColumn("sentence", tx.strip("sentence")).where(F.length("sentence") >= LEAST_CHARS).withColumn("t", tx.tokens("sentence")).where("size(t) > 0")
    common = F.size(F.array_intersect("q", "t")).cast("double")
    scored = s.join(q, "qid").withColumn("score", F.round(0.75 * common / F.size("q") + 0.25 * F.least(F.lit(1.0), 8 * common / F.size("t")), DIGITS)).where(common > 0)
    best = scored.selectExpr("*", "cast(row_number() over (partition by qid order by score desc, position, at) as bigint) as nth").where(F.col("nth") <= n)
    first = best.selectExpr("qid", "nth", "position", "coalesce(source, '') as source", "sentence", "score", "min(nth) over (partition by qid, coalesce(source, '')) as first_use")
    return first.selectExpr("qid", "nth", "position", "source", "sentence", "score", "cast(dense_rank() over (partition by qid order by first_use) as bigint) as citation")


def extractive_answers(queries: DataFrame, hits: DataFrame, n: int = ANSWER_SENTENCES) -> DataFrame:
    """(qid, answer, confident): the chosen sentences with their citations, or the fixed refusal."""
    cited = F.concat(F.regexp_replace("sentence", r"\.+$", ""), F.lit(" ["), F.col("citation"), F.lit("]."))
    parts = answer_sentences(queries, hits, n).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", cited.alias("s")))).alias("parts"))
    rows = queries.select("qid").join(parts, "qid", "left")
    return rows.select("qid", F.coalesce(F.array_join(F.transform("parts", lambda p: p["s"]), " "), F.lit(NO_ANSWER)).alias("answer"), F.col("parts").isNotNull().alias("confident"))


def answer_slices(answers: DataFrame, width: int = 24) -> DataFrame:
    """(qid, nth, slice): an answer in slices, as a client that reads a stream gets it."""
    n = F.greatest(F.lit(1), F.ceil(F.length("answer") / width)).cast("int")
    return answers.select("qid", "answer", F.explode(F.sequence(F.lit(0), n - 1)).alias("i")).select("qid", F.col("i").cast("long").alias("nth"), F.substring(F.col("answer"), F.col("i") * width + 1, F.lit(width)).alias("slice"))
