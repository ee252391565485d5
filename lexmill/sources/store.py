"""Documents and sessions as tables: upserts as unions of which the latest row counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upserted(existing: DataFrame, incoming: DataFrame, key: str = "doc_id", version: str = "updated_at") -> DataFrame:
    """One row per key, the latest version; of equal versions the incoming one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    turn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new")))
    return both.withColumn("_r", turn).where("_r = 1").drop("_r", "_new")


def listed(documents: DataFrame, user: str = "user_id", created: str = "created_at", key: str = "doc_id") -> DataFrame:
    """Documents with ``n``, their number among their user's from the newest on."""
    order = Window.partitionBy(user).orderBy(F.desc(created), F.desc(key))
    return documents.withColumn("n", F.row_number().over(order).cast("long"))


def with_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Messages (session, seq, role, content) with the ``turns`` (session, ord, question, answer, failed)
    that succeeded: two messages each, after those there, in a session that need not exist yet."""
    last = messages.groupBy("session").agg(F.max("seq").alias("_last"))
    done = turns.where("NOT failed").withColumn("_k", F.row_number().over(Window.partitionBy("session").orderBy("ord")) - 1)
    start = F.coalesce(F.col("_last") + 1, F.lit(0)) + 2 * F.col("_k")
    pair = F.array(*[F.struct((start + i).cast("long").alias("seq"), F.lit(role).alias("role"), F.col(c).alias("content")) for i, (role, c) in enumerate((("user", "question"), ("assistant", "answer")))])
    fresh = done.join(last, "session", "left").select("session", F.explode(pair).alias("m")).select("session", "m.*")
    return messages.select("session", "seq", "role", "content").unionByName(fresh)
