"""Operators as SQL over named relations: Catalyst plans them together, and another engine can run the same text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: What the two engines spell differently: (Spark, the other), with $1, $2 for the arguments.
MACROS = {
    "hash": ("CAST(conv(substr(md5($1), 1, 8), 16, 10) AS BIGINT)", "CAST('0x' || substr(md5($1), 1, 8) AS BIGINT)"),
    "quantile": ("percentile($1, $2)", "quantile_cont($1, $2)"),
    "last": ("last_value($1, true)", "last_value($1 IGNORE NULLS)"),
    "matches": ("($1) RLIKE $2", "regexp_matches($1, $2)"),
    "entries": ("map_from_entries(collect_list(CASE WHEN $1 IS NOT NULL THEN struct($1, $2) END))", "map_from_entries(coalesce(list(row($1, $2)) FILTER (WHERE $1 IS NOT NULL), []))"),
    "has": ("map_contains_key($1, $2)", "map_contains($1, $2)"),
    "get": ("try_element_at($1, $2)", "map_extract_value($1, $2)"),
}

#: Spark's setting of the shuffled bytes that a task takes at most, where there are enough partitions, and its value here: a row of counts
#: takes some 30 times its compressed bytes while a task sorts and groups it.
TASK, TASK_BYTES = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"


def small_tasks(spark: SparkSession) -> None:
    """Tasks of few rows. A session that has its own setting keeps it; the setting stays, as plans read it when they run."""
    if spark.conf.get(TASK, None) is None:
        spark.conf.set(TASK, TASK_BYTES)


def render(text: str, engine: int) -> str:
    def one(m: re.Match) -> str:
        out = MACROS[m[1]][engine]
        for i, a in enumerate(m[2].split("@@"), 1):
            out = out.replace(f"${i}", a.strip())
        return out

    return re.sub(r"#(\w+)\[\[(.*?)\]\]", one, text, flags=re.S)


class Op:
    """A relation defined by SQL over others, which stand in braces in its text: operators, or tables by name."""

    #: Whether its inputs are parsed each for itself: Spark can't always plan one that two others have named subqueries of.
    apart = False

    def __init__(self, name: str, text: str, **inputs: Op | str):
        self.name, self.text, self.inputs = name, text, inputs
        for t in re.findall(r"\{(\w+)\}", text):
            if t in TABLES:
                self.inputs.setdefault(t, t)

    def over(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The operator over DataFrames for all that its text names."""
        small_tasks(spark)
        return spark.sql(render(self.text, 0), **frames)

    def query(self, spark: SparkSession, sf_dir: str, held: dict | None = None) -> DataFrame:
        """The operator over the tables in a folder."""
        if self.apart:
            return self.over(spark, **{k: x.query(spark, sf_dir) for k, x in self.inputs.items()})
        held = {} if held is None else held
        for k, x in self.inputs.items():
            key = x if isinstance(x, str) else x.name
            if key not in held:
                held[key] = spark.read.parquet(f"{sf_dir}/{x}.parquet") if isinstance(x, str) else x.query(spark, sf_dir, held)
        return self.over(spark, **{k: held[x if isinstance(x, str) else x.name] for k, x in self.inputs.items()})

    def parts(self, held: dict[str, str]) -> dict[str, str]:
        for x in self.inputs.values():
            if not isinstance(x, str):
                x.parts(held)
        names = {k: x if isinstance(x, str) else f"r_{x.name}" for k, x in self.inputs.items()}
        held.setdefault(f"r_{self.name}", re.sub(r"\{(\w+)\}", lambda m: names[m[1]], render(self.text, 1)))
        return held

    def oracle(self) -> str:
        """The same over views of the tables' names, in one statement."""
        held = self.parts({})
        return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in held.items()) + f"\nSELECT * FROM r_{self.name}"


def numbers(n: int, name: str = "gi") -> str:
    """A relation of 0 to n - 1."""
    return f"(SELECT * FROM (VALUES {', '.join(f'({i})' for i in range(n))}) AS v({name}))"
