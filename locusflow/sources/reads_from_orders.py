"""Alignment records made from the lineitem table, for checks on tables without SAM files.

The lines of an order are dealt into pairs; positions, strands, clips,
qualities and libraries follow from the columns.  ``TABLES`` define the same
records, already with their derived columns, as the common table ``reads``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REFERENCES = [f"chr{i}" for i in range(1, 7)]
LIBRARIES = ["lib0", "lib1", "unknown", "unmapped"]
_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def raw_reads(lineitem: DataFrame) -> DataFrame:
    """lineitem as parsed records; one shuffle, one sort and one window, by order, as a line's mate is the next or the one before."""
    order = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    ok, q = F.col("l_orderkey"), F.col("l_quantity").cast("int")
    mated = ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    sides = [side(F.col(c)).over(order).alias(f"{name}_{c}") for name, side in (("next", F.lead), ("last", F.lag)) for c in mated]
    t = lineitem.select("l_orderkey", *_ORDER, (F.row_number().over(order) - 1).alias("r"), F.lead(F.lit(1)).over(order).alias("more"), *sides)
    second = F.col("r") % 2
    t = t.select("l_orderkey", *_ORDER, "r", F.when((second == 0) & F.col("more").isNull(), 1).otherwise(2).alias("n"), *[F.when(second == 0, F.col(f"next_{c}")).otherwise(F.col(f"last_{c}")).alias(f"m_{c}") for c in mated])
    t = t.withColumn("k", F.shiftright("r", 1))
    apart_by = lambda supplier, quantity: F.when(quantity.cast("int") >= 48, (ok + supplier) % 5).otherwise(ok % 5).cast("int")
    t = t.withColumn("c", F.when((F.col("n") == 1) & (ok % 2 == 0), 5).otherwise(apart_by(F.col("l_suppkey"), F.col("l_quantity"))))
    t = t.withColumn("m_c", F.when(F.col("n") == 2, apart_by(F.col("m_l_suppkey"), F.col("m_l_quantity"))))
    t = t.withColumn("apart", F.least("c", "m_c") != F.greatest("c", "m_c"))
    for mate in ("", "m_"):
        t = t.withColumn(f"{mate}pos", (1000 + F.col(f"{mate}l_partkey") % F.when(F.col("apart"), 5).otherwise(40)).cast("long"))
        t = t.withColumn(f"{mate}rev", (F.col(f"{mate}l_returnflag") == "R").cast("int"))
    for name in ("c", "pos", "rev"):
        t = t.withColumn(f"m_{name}", F.when(second == 0, F.coalesce(f"m_{name}", name)).otherwise(F.col(f"m_{name}")))
    clip = (F.col("l_linenumber") % 3).cast("int")
    text = F.when(clip > 0, F.concat(clip.cast("string"), F.lit("S"))).otherwise("")
    flag = F.lit(1).bitwiseOR(F.when(F.col("n") == 1, F.when(ok % 10 == 5, 12).otherwise(8)).otherwise(F.col("m_rev") * 32)).bitwiseOR(F.col("rev") * 16)
    flag = flag.bitwiseOR(F.when(second == 0, 64).otherwise(128)).bitwiseOR(F.when((F.col("l_linenumber") == 7) & (q > 45), 256).otherwise(0)).cast("int")
    lost = (F.col("n") == 1) & (ok % 10 == 5)
    rname = F.when(lost, F.lit("*")).otherwise(F.concat(F.lit("chr"), F.col("c") + 1))
    rnext = F.when(F.col("c") == F.col("m_c"), F.lit("=")).otherwise(F.concat(F.lit("chr"), F.col("m_c") + 1))
    of_first = lambda c: F.when(second == 0, F.col(c)).otherwise(F.col(f"m_{c}"))
    first_name = F.concat_ws(":", ok.cast("string"), F.col("k").cast("string"), (of_first("l_partkey") % 200).cast("string"), (of_first("l_suppkey") % 50).cast("string"))
    tags = F.when(ok % 7 == 0, F.array(F.lit("RG:Z:x"))).otherwise(F.array(F.lit("RG:Z:x"), F.concat(F.lit("LB:Z:lib"), (ok % 2).cast("string"))))
    out = t.select(
        (ok * 100 + F.col("r")).cast("long").alias("line_no"), first_name.alias("qname"), flag.alias("flag"), rname.alias("rname"), "pos", ((q + 10) % 60).cast("int").alias("mapq"),
        F.when(F.col("rev") == 1, F.concat(F.lit("10M"), text)).otherwise(F.concat(text, F.lit("10M"))).alias("cigar"), rnext.alias("rnext"), F.col("m_pos").alias("pnext"),
        F.lit(0).alias("tlen"), F.lit("*").alias("seq"), F.expr("repeat(char(33 + cast(l_quantity as int)), 10 + l_linenumber % 3)").alias("qual"), tags.alias("tags"),
    )
    return out.withColumn("line", F.concat_ws("\t", "qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", F.array_join("tags", "\t")))


#: The common tables of the SQL, each with those it reads; ``with_tables`` takes what a query needs.
TABLES = {
    "o": f"""
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(_ORDER)}) - 1 AS r, l_quantity::INTEGER AS q FROM lineitem
""",
    "k": """
  SELECT *, (r // 2)::INTEGER AS k FROM o
""",
    "n": """
  SELECT *, count(*) OVER (PARTITION BY l_orderkey, k) AS n FROM k
""",
    "c": """
  SELECT *, CASE WHEN n = 1 AND l_orderkey % 2 = 0 THEN 5 WHEN q >= 48 THEN (l_orderkey + l_suppkey) % 5 ELSE l_orderkey % 5 END::INTEGER AS c FROM n
""",
    "d": """
  SELECT *, min(c) OVER w <> max(c) OVER w AS apart, first_value(l_orderkey || ':' || k || ':' || l_partkey % 200 || ':' || l_suppkey % 50) OVER (PARTITION BY l_orderkey, k ORDER BY r) AS qname FROM c WINDOW w AS (PARTITION BY l_orderkey, k)
""",
    "p": """
  SELECT *, (1000 + l_partkey % CASE WHEN apart THEN 5 ELSE 40 END)::BIGINT AS pos, (l_returnflag = 'R')::INTEGER AS rev, (l_linenumber % 3)::INTEGER AS clip FROM d
""",
    "m": """
  SELECT a.*, b.c AS b_c, coalesce(b.pos, a.pos) AS pnext, coalesce(b.rev, a.rev) AS m_rev, coalesce(b.c, a.c) AS m_c
  FROM p a LEFT JOIN p b ON a.l_orderkey = b.l_orderkey AND a.k = b.k AND a.r <> b.r
""",
    "reads": """
  SELECT l_orderkey * 100 + r AS line_no, qname, n, apart, clip,
    (1 + CASE WHEN n = 1 THEN CASE WHEN l_orderkey % 10 = 5 THEN 12 ELSE 8 END ELSE m_rev * 32 END + rev * 16 + CASE WHEN r % 2 = 0 THEN 64 ELSE 128 END
      + CASE WHEN l_linenumber = 7 AND q > 45 THEN 256 ELSE 0 END)::INTEGER AS flag,
    CASE WHEN n = 1 AND l_orderkey % 10 = 5 THEN '*' ELSE 'chr' || (c + 1) END AS rname,
    CASE WHEN n = 1 AND l_orderkey % 10 = 5 THEN -1 ELSE c END::INTEGER AS ref_idx,
    CASE WHEN c <> m_c THEN m_c WHEN n = 1 AND l_orderkey % 10 = 5 THEN -1 ELSE c END::INTEGER AS mate_idx,
    CASE WHEN n = 1 AND l_orderkey % 10 = 5 THEN 'unmapped' WHEN apart THEN 'discordant' ELSE 'chr' || (c + 1) END AS bucket,
    pos, pnext, ((q + 10) % 60)::INTEGER AS mapq, (r % 2 + 1)::INTEGER AS "end", rev, CASE WHEN n = 1 THEN 0 ELSE m_rev END::INTEGER AS mrev,
    CASE WHEN rev = 1 THEN pos + 9 + clip ELSE pos - clip END::BIGINT AS u, CASE WHEN q >= 15 THEN q * (10 + clip) ELSE 0 END::INTEGER AS score,
    CASE WHEN l_orderkey % 7 = 0 THEN 0 ELSE l_orderkey % 2 END::INTEGER AS lb, n > 1 AS paired,
    NOT (n = 1 AND l_orderkey % 10 = 5) AND NOT (l_linenumber = 7 AND q > 45) AS eligible,
    concat_ws(chr(9), qname, flag, rname, pos, mapq, CASE WHEN rev = 1 THEN '10M' ELSE '' END || CASE WHEN clip > 0 THEN clip || 'S' ELSE '' END || CASE WHEN rev = 1 THEN '' ELSE '10M' END,
      CASE WHEN c = m_c THEN '=' ELSE 'chr' || (m_c + 1) END, pnext, 0, '*', repeat(chr(33 + q), (10 + l_linenumber % 3)::INTEGER),
      'RG:Z:x', CASE WHEN l_orderkey % 7 <> 0 THEN 'LB:Z:lib' || l_orderkey % 2 END) AS line
  FROM m
""",
    "covered": """
  SELECT bucket, min(pos) AS first_pos, max(pos) AS last_pos FROM reads WHERE pos % 4 IN (1, 2) GROUP BY bucket, pos // 4
""",
    "named": """
  SELECT bucket, qname, line_no, pos, u, rev, mrev, score, lb, ref_idx, mate_idx, row_number() OVER (PARTITION BY bucket, qname ORDER BY pos, line_no) AS place
  FROM reads WHERE eligible AND paired
""",
    "ab": """
  SELECT a.bucket, a.qname, a.line_no AS a_line, b.line_no AS b_line, a.pos AS a_pos, b.pos AS b_pos, a.u AS a_u, b.u AS b_u, a.rev AS a_rev, b.rev AS b_rev, a.mrev AS a_mrev,
    a.score AS a_score, b.score AS b_score, a.lb AS a_lb, b.lb AS b_lb, a.ref_idx AS a_ref, b.ref_idx AS b_ref, a.mate_idx AS a_mate, b.mate_idx AS b_mate
  FROM named a JOIN named b ON a.bucket = b.bucket AND a.qname = b.qname WHERE a.place = 1 AND b.place = 2
""",
    "ends": """
  SELECT bucket, qname, CASE WHEN swap THEN b_lb ELSE a_lb END AS lb, CASE WHEN swap THEN b_ref ELSE a_ref END AS rep_ref, CASE WHEN swap THEN b_u ELSE a_u END AS rep_u,
    CASE WHEN a_u = b_u THEN 3 ELSE CASE (CASE WHEN swap THEN b_rev * 2 + a_rev ELSE a_rev * 2 + a_mrev END) WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 4 ELSE 5 END END::INTEGER AS orient,
    CASE WHEN swap THEN a_u ELSE b_u END AS mate_u, CASE WHEN swap THEN b_mate ELSE a_mate END AS mate_ref, (a_score + b_score)::INTEGER AS pair_score,
    CASE WHEN swap THEN b_pos ELSE a_pos END AS rep_pos, CASE WHEN swap THEN b_line ELSE a_line END AS rep_line, CASE WHEN swap THEN a_line ELSE b_line END AS oth_line,
    CASE WHEN swap THEN b_score ELSE a_score END AS rep_score
  FROM (SELECT *, bucket <> 'discordant' AND b_u < a_u AS swap FROM ab)
""",
    "ranked": """
  SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY bucket, lb, rep_ref, rep_u, orient, mate_u, mate_ref) AS size FROM ends
  WINDOW w AS (PARTITION BY bucket, lb, rep_ref, rep_u, orient, mate_u, mate_ref ORDER BY pair_score DESC, rep_pos, rep_line)
""",
    "frags": """
  SELECT *, bool_or(paired) OVER (PARTITION BY bucket, lb, ref_idx, u, rev) AS has_paired,
    row_number() OVER (PARTITION BY bucket, lb, ref_idx, u, rev, paired ORDER BY score DESC, mate_idx, pnext, pos, line_no) AS place
  FROM reads WHERE eligible
""",
    "lost": """
  SELECT rep_line AS line_no FROM ranked WHERE place > 1 UNION SELECT oth_line FROM ranked WHERE place > 1
  UNION SELECT line_no FROM frags WHERE NOT paired AND (has_paired OR place > 1)
""",
    "marked": """
  SELECT reads.*, lost.line_no IS NOT NULL AS is_dup FROM reads LEFT JOIN lost ON reads.line_no = lost.line_no
""",
    "apart": """
  SELECT rep_line, oth_line, row_number() OVER (PARTITION BY bucket, lb, rep_ref, rep_u, orient, mate_u, mate_ref
    ORDER BY CASE WHEN bucket = 'discordant' THEN rep_score ELSE pair_score END DESC, rep_pos, rep_line) AS place FROM ends
""",
    "lost_apart": """
  SELECT rep_line AS line_no FROM apart WHERE place > 1 UNION SELECT oth_line FROM apart WHERE place > 1
  UNION SELECT line_no FROM frags WHERE NOT paired AND (has_paired OR place > 1)
""",
    "clusters": """
  SELECT bucket, list(rep_line ORDER BY rep_pos, rep_line) AS ls, list(place = 1 ORDER BY rep_pos, rep_line) AS bs, count(*) AS n,
    list(split_part(qname, ':', 3)::INTEGER ORDER BY rep_pos, rep_line) AS xs, list(split_part(qname, ':', 4)::INTEGER ORDER BY rep_pos, rep_line) AS ys
  FROM ranked WHERE size > 1 GROUP BY bucket, lb, rep_ref, rep_u, orient, mate_u, mate_ref
""",
    "spots": """
  SELECT *, list_position(bs, true) AS w FROM clusters
""",
    "walk": """
  SELECT *, 1::BIGINT AS i, list_transform(range(1, n + 1), lambda j: j <> w AND abs(xs[j] - xs[w]) <= 20 AND abs(ys[j] - ys[w]) <= 20) AS near FROM spots
  UNION ALL
  SELECT * EXCLUDE (i, near, later), i + 1, list_transform(range(1, n + 1), lambda j: near[j] OR (i <> w AND len(later) > 0 AND (j = i OR list_contains(CASE WHEN near[i] THEN later ELSE later[2:] END, j))))
  FROM (SELECT *, list_filter(range(i + 1, n + 1), lambda j: j <> w AND abs(xs[j] - xs[i]) <= 20 AND abs(ys[j] - ys[i]) <= 20) AS later FROM walk WHERE i <= n)
""",
    "optical": """
  SELECT bucket, ls[j] AS rep_line FROM (SELECT bucket, ls, near, unnest(range(1, n + 1)) AS j FROM walk WHERE i = n + 1) WHERE near[j]
""",
}


def with_tables(select: str) -> str:
    """A SELECT over TABLES with the definitions of those it needs, in order."""
    needed, asked = set(), [select]
    while asked:
        text = asked.pop()
        new = {name for name in TABLES if name not in needed and re.search(rf"\b(?:FROM|JOIN) {name}\b", text)}
        needed |= new
        asked += [TABLES[name] for name in new]
    tables = ", ".join(f"{name} AS ({body})" for name, body in TABLES.items() if name in needed)
    return f"WITH {'RECURSIVE ' if 'walk' in needed else ''}{tables} SELECT {select}"
