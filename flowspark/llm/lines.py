"""Line dedup over content-defined chunks of lines.

A text is split at newlines. A rolling hash over the hashes of ``WINDOW`` lines closes a chunk
wherever it is divisible by ``DIVISOR``, so a boundary depends on the lines next to it only: lines
that are put in or taken out elsewhere do not shift it. A chunk of two lines or more that occurs
anywhere else in the table is kept at its first place (smallest ``doc_id``, then place in the text)
and removed everywhere else. Candidates are found by a 64-bit hash of the chunk; a chunk is removed
only if its bytes equal those of an earlier one.

Built-in functions only. Hashes are grouped before any text moves; texts are shuffled by row once to
take out the chunks to compare and once to rebuild the texts. A chunk that is in a third of all rows
is aggregated map-side, and the joins that bring its owner back have one row per chunk on one side,
so that a skewed partition of the other side can be split (adaptive skew join).

Edge cases: a null text has no lines and stays null; an empty text is one empty line. Rows that agree
in ``doc_id`` and text are one document: they get the same result and do not remove each other's
lines. Extra columns are carried along; a row with a null id is a document like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.registry import query, table

#: Lines per rolling hash, and the average number of lines between boundaries.
WINDOW = 2
DIVISOR = 3
_BASE = 1_000_003
_PRIME = 2_147_483_647


def _chunks(text: str) -> str:
    """SQL for the array of chunks (arrays of lines) of a text.

    ``transform(array(x), v -> ...)[0]`` binds ``v`` to ``x`` once; without it the line hashes
    would be computed again for every line.
    """
    rolled = "hs[i]"
    for back in range(1, WINDOW):
        rolled = f"{rolled} + coalesce(get(hs, i - {back}), 0L) * {_BASE ** back}L"
    return f"""
        transform(array(split({text}, '\\n', -1)), ls ->
          transform(array(transform(ls,
              l -> cast(conv(substr(md5(l), 1, 8), 16, 10) as bigint))), hs ->
            transform(array(filter(sequence(0, size(ls) - 1),
                i -> i = size(ls) - 1 or ({rolled}) % {_PRIME} % {DIVISOR} = 0)), ends ->
              transform(ends, (e, j) -> slice(ls, coalesce(get(ends, j - 1), -1) + 2,
                                              e - coalesce(get(ends, j - 1), -1)))
            )[0])[0])[0]"""


def remove_repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated chunks taken out of ``text``, and ``n_lines`` and ``n_removed``."""
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    rows = docs.select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("_row"),
                       F.col(text).alias("_text"), *[F.col(c).alias(f"_c{i}")
                                                     for i, c in enumerate(rest)])
    split = F.expr(_chunks("_text"))
    multi = (rows.where(F.col("_text").isNotNull())
             .select("_row", F.posexplode(split).alias("chunk", "lines"))
             .where(F.size("lines") >= 2)
             .select("_row", "chunk", F.xxhash64(F.array_join("lines", "\n")).alias("h")))
    several = multi.groupBy("h").agg(F.min(F.struct("_row", "chunk")).alias("lo"),
                                     F.max(F.struct("_row", "chunk")).alias("hi"))
    several = several.where("lo <> hi").select("h")
    wanted = multi.join(several, "h", "left_semi")
    by_row = wanted.groupBy("_row").agg(F.collect_set("chunk").alias("wanted"))
    pieces = F.expr(f"""transform(array({_chunks('_text')}), cs -> transform(wanted,
        i -> struct(i as chunk, array_join(cs[i], '\n') as bytes)))[0]""")
    seen = (rows.select("_row", "_text").join(by_row, "_row").dropDuplicates(["_row"])
            .select("_row", F.explode(pieces).alias("p")).select("_row", "p.chunk", "p.bytes"))
    owner = (seen.groupBy("bytes")
             .agg(F.min(F.struct("_row", "chunk")).alias("first")))
    repeated = (seen.join(owner, "bytes")
                .where(F.struct("_row", "chunk") != F.col("first"))
                .groupBy("_row").agg(F.collect_set("chunk").alias("gone")))
    out = rows.join(repeated, "_row", "left").withColumn("chunks", split)
    kept = F.expr("""transform(array(struct(chunks as cs, concat(array(-1), array_sort(gone), array(size(chunks)))
        as cut)), s -> flatten(transform(sequence(1, size(s.cut) - 1),
            j -> slice(s.cs, s.cut[j - 1] + 2, s.cut[j] - s.cut[j - 1] - 1))))[0]""")  # what lies between removed ones
    lines = lambda cs: F.coalesce(F.aggregate(cs, F.lit(0), lambda n, c: n + F.size(c)), F.lit(0))
    out = out.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    clean = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten("kept"), "\n"))
    n_removed = F.when(F.col("gone").isNull(), 0).otherwise(lines(F.col("chunks")) - lines(F.col("kept")))
    made = {text: clean} | {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    return out.select(*[made[c].alias(c) for c in docs.columns if c in made],
                      lines(F.col("chunks")).cast("long").alias("n_lines"),
                      n_removed.cast("long").alias("n_removed"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
h AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM l),
r AS (SELECT *, (h + coalesce(lag(h) OVER w, 0) * {_BASE}) % {_PRIME} % {DIVISOR} = 0 AS cut
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM r),
g AS (SELECT doc_id, chunk, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS bytes
      FROM c GROUP BY doc_id, chunk),
o AS (SELECT *, row_number() OVER (PARTITION BY bytes, n >= 2 ORDER BY doc_id, chunk) > 1 AND n >= 2
        AS gone FROM g)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines,
       coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(bytes, chr(10) ORDER BY chunk) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id) GROUP BY d.doc_id"""


@query("op2_line_dedup", ORACLE)
def line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = remove_repeated_chunks(docs)
    return out.select("doc_id", "n_lines", "n_removed",
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """Documents without their repeated chunks; one of which nothing is left goes.

    Rows with a null id, repeated rows and null texts are treated as ``remove_repeated_chunks`` says. ``text``
    and ``n_chars``, where there is one, are brought up to date; all other columns, under any names, are kept as they
    are.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = docs.select("doc_id", "text", *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(rest)])
    out = remove_repeated_chunks(inner).where("n_removed = 0 or text <> ''")
    made = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    made |= {c: F.col(f"_keep{i}") for i, c in enumerate(rest)}
    if "n_chars" in made:
        made["n_chars"] = F.coalesce(F.length("text").cast("long"), F.lit(0))
    return out.select(*[made[c].alias(c) for c in docs.columns])
