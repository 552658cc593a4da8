"""Numeric text formats as tables: CSV matrices, MatrixMarket, DIMACS CNF, SDPA sparse; and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.errors import need
from fathom.operators.running import running


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = False, lenient: bool = False) -> DataFrame:
    """Columns of doubles. Blank or non-numeric fields are null; lenient: 0."""
    df = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).csv(path, header=header, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.select(*((F.coalesce(v, F.lit(0.0)) if lenient else v).alias(c) for c in columns for v in [F.col(c).try_cast("double")]))


def write_csv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.csv(path, header=header)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v), indices from 1, of a coordinate file; symmetric and skew-symmetric headers are unfolded, duplicates summed."""
    lines = _lines(spark, path)
    head = (lines.where(F.col("line").startswith("%%MatrixMarket")).first() or [""])[0].lower().split()
    need(len(head) == 5 and head[2] == "coordinate", "a MatrixMarket coordinate file")
    p = lines.where(~F.col("line").startswith("%")).select(F.split("line", r"\s+").alias("p"))
    value = F.lit(1.0) if head[3] == "pattern" else F.col("p")[2].cast("double")
    # the size line has three integers and is the only line whose first two numbers bound all others
    size = p.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), F.col("p")[2].cast("long").alias("n")).first()
    e = p.select(F.col("p")[0].cast("long").alias("i"), F.col("p")[1].cast("long").alias("j"), value.alias("v"), F.monotonically_increasing_id().alias("k"))
    e = e.where("k > 0").drop("k")
    need(size is not None, "a size line")
    if head[4] in ("symmetric", "skew-symmetric"):
        sign = -1.0 if head[4].startswith("skew") else 1.0
        e = e.union(e.where("i <> j").select("j", "i", F.col("v") * sign))
    return e.groupBy("i", "j").agg(F.sum("v").alias("v"))


def write_matrix_market(a: DataFrame, path: str) -> None:
    """One part file: a header can stand once only."""
    s = a.agg(F.coalesce(F.max("i"), F.lit(0)).alias("m"), F.coalesce(F.max("j"), F.lit(0)).alias("n"), F.count("*").alias("k"))
    head = s.select(F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit("%%MatrixMarket matrix coordinate real general").alias("value")), F.struct(F.lit(1).alias("o"), F.concat_ws(" ", "m", "n", "k").alias("value")))).alias("x")).select("x.o", "x.value", F.lit(0).alias("i"), F.lit(0).alias("j"))
    body = a.select(F.lit(2).alias("o"), F.concat_ws(" ", "i", "j", "v").alias("value"), "i", "j")
    head.union(body).coalesce(1).sortWithinPartitions("o", "i", "j").select("value").write.text(path)


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """(clause_id, var, negated) of a CNF file; clauses may span lines of one part."""
    # lines in file order: by the start of their split, then as they stand in it
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where("line <> ''").where(~F.col("line").rlike("^[cp%]")).select("split", "at", F.transform(F.split("line", r"\s+"), lambda x: x.cast("long")).alias("xs"))
    ended = F.size(F.filter("xs", lambda x: x == 0))
    lines = running(lines, ["split", "at"], upto=("sum", ended)).withColumn("before", F.col("upto") - ended)
    tokens = lines.select("before", "xs", F.posexplode("xs").alias("i", "x")).where("x <> 0")
    k = F.col("before") + F.size(F.filter(F.slice("xs", F.lit(1), F.col("i") + 1), lambda x: x == 0))
    return tokens.select(k.cast("long").alias("clause_id"), F.abs("x").alias("var"), (F.col("x") < 0).alias("negated"))


def write_dimacs(clauses: DataFrame, n_vars: int, path: str) -> None:
    """One part file: the header stands first, then a line a clause."""
    c = clauses.groupBy("clause_id").agg(F.concat(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(F.col("negated"), -F.col("var")).otherwise(F.col("var")))), lambda x: x.cast("string"))), F.lit(" 0")).alias("value"))
    head = c.agg(F.concat(F.lit(f"p cnf {n_vars} "), F.count("*").cast("string")).alias("value")).select(F.lit(-1).cast("long").alias("clause_id"), "value")
    head.union(c.select("clause_id", "value")).coalesce(1).sortWithinPartitions("clause_id").select("value").write.text(path)


def sat_models(clauses: DataFrame, n_vars: int) -> DataFrame:
    """Assignments (bits of `model`) that satisfy every clause, by enumeration: up to 24 variables."""
    need(n_vars <= 24, "24 variables at most")
    bit = F.expr("shiftleft(1L, cast(var as int) - 1)")
    masks = clauses.groupBy("clause_id").agg(F.bit_or(F.when(F.col("negated"), F.lit(0).cast("long")).otherwise(bit)).alias("on"), F.bit_or(F.when(F.col("negated"), bit).otherwise(F.lit(0).cast("long"))).alias("off")).select("on", "off").distinct()
    need(masks.limit(MOST_CLAUSES + 1).count() <= MOST_CLAUSES, f"{MOST_CLAUSES} different clauses at most")
    # every model meets the clauses as one array, with no join
    all_ = masks.agg(F.collect_list(F.struct("on", "off")).alias("clauses"))
    x = clauses.sparkSession.range(1 << n_vars).withColumnRenamed("id", "model").join(F.broadcast(all_))  # one row
    holds = lambda c: (F.col("model").bitwiseAND(c["on"]) != 0) | (F.bitwise_not("model").bitwiseAND(c["off"]) != 0)
    return x.where(F.forall("clauses", holds)).select("model")


#: Different clauses that enumeration takes.
MOST_CLAUSES = 100_000


def read_sdpa(spark: SparkSession, path: str) -> tuple[list[float], DataFrame]:
    """Right-hand sides, and entries (k, i, j, v) of a single-block sparse file; k = 0 is the objective."""
    text = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    text = text.where("line <> ''").where(~F.col("line").rlike('^[*"]'))
    # the four lines of the head; all others are entries
    head = text.orderBy("split", "at").limit(4).collect()
    need(len(head) == 4 and int(head[1].line.split()[0]) == 1, "a single-block SDPA file")
    n, b = int(head[2].line.split()[0]), [float(x) for x in head[3].line.replace(",", " ").split()]
    rest = text.where((F.col("split") > head[3]["split"]) | (F.col("split") == head[3]["split"]) & (F.col("at") > head[3]["at"]))
    p = F.split("line", r"\s+")
    e = rest.select("line", F.size(p).alias("m"), *(p[k].try_cast(t).alias(c) for k, t, c in ((0, "int", "k"), (2, "int", "i"), (3, "int", "j"), (4, "double", "v"))))
    good = (F.col("m") == 5) & F.col("i").between(1, n) & F.col("j").between(1, n) & F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v")
    bad = e.where(~F.coalesce(good, F.lit(False))).first()
    need(bad is None, f"entry {bad and bad.line} is out of bounds")
    return b, e.select("k", "i", "j", "v")


def write_sdpa(b: list[float], entries: DataFrame, n: int, path: str) -> None:
    """One part file: the head, then entries (k, i, j, v) of one block of n rows."""
    head = [str(len(b)), "1", str(n), " ".join(map(repr, b))]
    h = entries.sparkSession.createDataFrame([(-4 + k, 0, 0, x) for k, x in enumerate(head)], "k int, i int, j int, value string")
    body = entries.select("k", "i", "j", F.concat_ws(" ", "k", F.lit("1"), "i", "j", F.col("v").cast("string")).alias("value"))
    h.union(body).coalesce(1).sortWithinPartitions("k", "i", "j").select("value").write.text(path)
