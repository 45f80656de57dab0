"""Whole pipelines as one lazy plan: documents to searchable chunks, questions to answers, messages to replies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.chunking import chunk_documents
from loomline.operators.ingest import chunk_key
from loomline.operators.retrieval import retrieve, with_empty
from loomline.operators.vector import THRESHOLD, TOP_K, embed, top_k
from loomline.streaming.limits import LIMIT, WINDOW_SECONDS, rate_limit

Model = Callable[[Column], Column]


def index_documents(docs: DataFrame, dimensions: int = 256, strategy: str = "sentence", size: int = 500, overlap: int = 50, model: Model | None = None) -> DataFrame:
    """Chunks with a stable id and a vector; chunks that give no vector are left out."""
    chunks = chunk_documents(docs, strategy=strategy, size=size, overlap=overlap)
    embedding = model(F.col("text")) if model else embed(F.col("text"), dimensions)
    return chunks.withColumns({"point_id": chunk_key(F.col("url"), F.col("chunk_index")), "embedding": embedding}).where("embedding is not null")


def answer(
    questions: DataFrame, points: DataFrame, dimensions: int = 256, k: int = TOP_K, threshold: float = THRESHOLD, model: Model | None = None,
    generate: Callable[[Column, Column], Column] | None = None, fallback: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(query_id, question, intent, context, confidence, reply): routing, retrieval, generation.

    The costly router runs only on questions the keywords do not decide: they are a branch of
    their own. Without a model the reply is the first source found.
    """
    vectors = questions.withColumn("embedding", model(F.col("question")) if model else embed(F.col("question"), dimensions))
    hits = top_k(points.withColumnRenamed("point_id", "vec_id"), vectors, k, threshold).withColumnRenamed("vec_id", "doc_id")
    documents = points.select(
        F.col("point_id").alias("doc_id"), "text", *[F.col(c) if c in points.columns else F.lit(None).cast("string").alias(c) for c in ("source", "title", "url", "document_date")]
    )
    found = with_empty(questions, retrieve(hits, documents))
    routed = found.withColumn("intent", T.route(F.col("question"), T.INTENTS))
    if fallback is not None:
        undecided = routed.where("intent = 'uncertain'").withColumn("intent", fallback(F.col("question")))
        routed = routed.where("intent <> 'uncertain'").unionByName(undecided)
    reply = generate(F.col("question"), F.col("context")) if generate else F.coalesce(F.col("sources")[0]["text"], F.lit(""))
    return routed.select("query_id", "question", "intent", "context", "confidence", T.format_message(reply).alias("reply"))


def gate_messages(messages: DataFrame, account: str) -> DataFrame:
    """Messages (user_id, ts, text, chat_type, is_command, is_edited, is_reply) that are to be answered, or why they are not.

    Works on a stream as on a table: only column functions.
    """
    plain = messages.where(~F.coalesce("is_command", F.lit(False)) & ~F.coalesce("is_edited", F.lit(False)) & F.col("text").isNotNull())
    heard = plain.where((F.col("chat_type") == "private") | T.addressed(F.col("text"), account, F.col("is_reply")))
    return heard.withColumns(
        {"question": T.without_mention(F.col("text"), account), "rejected": T.rejection(F.col("text")), "language": T.message_language(F.col("text"))}
    )


#: What a message that is not answered gets instead, by the reason.
NOTICES = {
    "rate_limited": "Забагато запитів. Спробуйте, будь ласка, за хвилину.",
    "spam_detected": "Повідомлення схоже на спам.",
    "message_too_long": "Повідомлення занадто довге.",
    "empty_message": "Повідомлення порожнє.",
}


def reply_messages(
    messages: DataFrame, points: DataFrame, account: str, dimensions: int = 256, limit: int = LIMIT, window: float = WINDOW_SECONDS, translate: Model | None = None,
    validate: Callable[[Column], Column] | None = None, safe_reply: str = "", notices: dict[str, str] = NOTICES, **options,
) -> DataFrame:
    """(message_id, user_id, status, language, question, intent, reply): every message the account hears, from the gates to the formatted reply.

    In order: mention, rate limit (over all heard messages of a user, admitted ones counting),
    content, mention stripped, language, translation of Russian (``translate``; a blank or failed
    one leaves the question), routing and retrieval, ``validate`` (whether a reply may go
    out, else ``safe_reply``), formatting. Only admitted and valid messages reach the index.
    """
    heard = gate_messages(messages, account)
    admitted = rate_limit(heard, limit, window, event_id="message_id").select(F.col("message_id").alias("__m"), "admitted")
    marked = heard.join(admitted, F.col("message_id") == F.col("__m"), "left").drop("__m")
    reason = F.when(~F.coalesce("admitted", F.lit(False)), "rate_limited").when(F.col("rejected") != "", F.col("rejected")).otherwise("answered")
    language = T.message_language(F.col("question"))
    question = F.col("question")
    if translate is not None:
        translated = translate(question)
        question = F.when((language == "ru") & (T.strip(F.coalesce(translated, F.lit(""))) != ""), translated).otherwise(question)
    staged = marked.select("message_id", "user_id", reason.alias("status"), language.alias("language"), question.alias("question"))
    asked = staged.where("status = 'answered'").select(F.col("message_id").alias("query_id"), "question")
    answered = answer(asked, points, dimensions, **options).select(F.col("query_id").alias("__q"), "intent", F.col("reply").alias("__reply"))
    joined = staged.join(answered, F.col("message_id") == F.col("__q"), "left")
    reply = F.col("__reply") if validate is None else F.when(validate(F.col("__reply")), F.col("__reply")).otherwise(F.lit(safe_reply))
    return joined.select(
        "message_id", "user_id", "status", "language", "question", "intent", F.when(F.col("status") == "answered", reply).otherwise(T.lookup(F.col("status"), notices, "")).alias("reply")
    )


def send_replies(replies: DataFrame, send: Callable[[object, str, bool], None]) -> DataFrame:
    """(user_id, sent, error) after ``send(user, text, marked_up)`` for each reply; one whose marks are refused goes out again as plain text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for user, text in zip(pdf["user_id"], pdf["reply"]):
                sent, error = "", None
                for form, marked_up in (("markdown", True), ("plain", False)):
                    try:
                        send(user, text, marked_up)
                        sent, error = form, None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                rows.append((user, sent, error))
            yield pd.DataFrame(rows, columns=["user_id", "sent", "error"], dtype=object)

    kind = replies.schema["user_id"].dataType.simpleString()
    return replies.where(F.coalesce("reply", F.lit("")) != "").select("user_id", "reply").mapInPandas(run, f"user_id {kind}, sent string, error string")


def reply_stream(replies: DataFrame, send: Callable[[object, str, bool], None], checkpoint: str):
    """A streaming query that sends each micro-batch of replies once it is worked out."""
    return replies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: send_replies(batch, send).write.format("noop").mode("overwrite").save())
