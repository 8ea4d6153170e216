"""Secrets in whole texts, found through an inverted index of trigrams.

Each rule's regular expression gives a Boolean query over trigrams. The index maps
every trigram that some query names to the texts that hold it; a clause of a query
is answered by intersecting its trigrams' postings, and only texts that answer a
rule are searched with its expression. A rule without mandatory trigrams searches
every text.

Texts are known to the index by their 64-bit hash: copies share one posting, and a
collision could only add a candidate. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.registry import query, table
from tidewatch.llm.tables import col, materialize, packed
from tidewatch.llm.trigrams import mandatory


class Rule(NamedTuple):
    """``pattern`` in the syntax Java and Python share; ``group`` is the secret itself,
    kept only if it has ``least`` characters."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# Maximal runs, so a repeat count in place of a length test gives the same matches.
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = (*BASE_RULES, *EXTRA_RULES)
FOLD_BLOCK = 256


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def index(texts: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """Postings ``(gram, key)``: which texts ``(key, text)`` hold which trigram, each once."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(g), F.lit(i)) for i, g in enumerate(trigrams)]))
    return low.select("key", F.explode(held).alias("gram")).distinct()


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(key, rules)``: the numbers of the rules whose trigram query a text answers."""
    clauses = [(r, c, q) for r, rule in enumerate(rules) for c, q in enumerate(mandatory(rule.pattern) or ())]
    grams = sorted({g for _, _, q in clauses for g in q})
    spark = texts.sparkSession
    rows = [(grams.index(g), r, c, len(q)) for r, c, q in clauses for g in sorted(q)]
    # One row per trigram of a clause: bounded by the rules, not by the data.
    wanted = F.broadcast(spark.createDataFrame(rows, "gram int, rule int, clause int, need int"))
    met = (index(texts, grams).join(wanted, "gram")
           .groupBy("key", "rule", "clause", "need").agg(F.count("*").alias("n"))
           .filter("n = need"))
    return met.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _starts(pieces: Column, found: Column) -> Column:
    """Where each match starts: lengths of the text before, between and of the matches.

    Summed in blocks, so a text of many matches costs no square of their number.
    """
    n = F.size(found)
    steps = F.zip_with(F.slice(pieces, 1, n), found, lambda p, f: F.struct(
        F.length(p).cast("long").alias("gap"), F.length(f).cast("long").alias("len")))

    def run(part: Column, base: Column) -> Column:
        zero = F.struct(base.cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
        return F.aggregate(part, zero, lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["len"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"),
                                                  (acc["at"] + x["gap"] + x["len"]).alias("end")))).alias("out")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / FOLD_BLOCK).cast("int")),
                         lambda b: F.slice(steps, b * FOLD_BLOCK + 1, FOLD_BLOCK))
    zero = F.struct(F.lit(0).cast("long").alias("at"),
                    F.array().cast("array<array<struct<start:bigint,end:bigint>>>").alias("out"))

    def block(acc: Column, part: Column) -> Column:
        done = run(part, acc["at"])
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    return F.flatten(F.aggregate(blocks, zero, block)["out"])


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule that are long enough, as ``(start, rank, end)``."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    marked = F.zip_with(_starts(F.split(text, rule.pattern), found), secret, lambda at, s: F.struct(
        at["start"].alias("start"), F.lit(rank).alias("rank"), at["end"].alias("end"),
        F.length(s).alias("n")))
    kept = F.transform(F.filter(marked, lambda m: m["n"] >= rule.least),
                       lambda m: F.struct(m["start"], m["rank"], m["end"]))
    return F.when(text.rlike(rule.pattern), kept)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Every document as ``row``, with ``spans``: ``(start, rank, end)`` sorted.

    Spans count code points, end exclusive; ``rank`` is the rule's place in
    ``rules``. NULL counts as empty and gives no spans; repeated rows give the
    same result each; an empty table gives an empty table.
    """
    body = F.coalesce(col(text), F.lit(""))
    texts = docs.select(body.alias("text")).withColumn("key", F.xxhash64("text"))
    found = materialize(candidates(texts, rules), "secrets-candidates")
    whole = packed(docs, text=body).withColumn("key", F.xxhash64("text"))
    joined = whole.join(found.hint("shuffle_hash"), "key", "left")
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    per_rule = []
    for rank, rule in enumerate(rules):
        spans = _spans(F.col("text"), rule, rank)
        if mandatory(rule.pattern) is not None:
            spans = F.when(F.array_contains("rules", rank), spans)
        per_rule.append(F.coalesce(spans, nothing))
    return joined.select("row", "text", F.sort_array(_joined(per_rule)).alias("spans"))


def written(spans: Column, rules: Sequence[Rule]) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(found: DataFrame) -> DataFrame:
    """Adds ``clean``: the text with each stretch that spans cover replaced by ``[SECRET]``."""
    text = F.col("text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] > acc["at"]) | (F.size(acc["out"]) == 0), F.concat(acc["out"], F.array(gap, F.lit("[SECRET]"))))
            .otherwise(acc["out"]).alias("out"))

    done = F.aggregate(F.col("spans"), zero, cut)
    rest = F.substring(text, (F.col("done.at") + 1).cast("int"), F.length(text))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join("done.out", ""), rest))
    return found.withColumn("done", done).withColumn("clean", clean).drop("done")


def _sql() -> str:
    """The same spans in DuckDB: split at the matches, add up lengths."""
    found, spans = [], []
    for rank, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(f"string_split_regex(t, '{p}') AS p{rank}, regexp_extract_all(t, '{p}', 0) AS m{rank}, "
                     f"regexp_extract_all(t, '{p}', {r.group}) AS g{rank}")
        start = (f"CAST(list_sum([length(x) for x in p{rank}[1:i]]) + coalesce(list_sum([length(x) for x in m{rank}[1:i - 1]]), 0) AS BIGINT)")
        spans.append(f"[{{'a': {start}, 'r': {rank}, 'b': {start} + length(m{rank}[i])}} for i in generate_series(1, len(m{rank})) "
                     f"if length(g{rank}[i]) >= {r.least}]")
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = f"array_to_string([{names}[x.r + 1] || ':' || x.a || ':' || x.b for x in {{}}], ',')"
    base = f"[x for x in s if x.r < {len(BASE_RULES)}]"
    counts = ", ".join(f"CAST(len([x for x in s if x.r = {i}]) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {', '.join(found)} FROM d),
  u AS (SELECT doc_id, list_sort(flatten([{', '.join(spans)}])) AS s FROM f)
SELECT doc_id, {counts}, sha256({text.format(base)}) AS base_sha256, {text.format('s')} AS spans FROM u"""


@query("op2_secret_scan", _sql())
def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    found = found.select("row.doc_id", "spans", base.alias("base"))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [F.size(F.filter(ranks, F.lit(i).__eq__)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base"), RULES), 256).alias("base_sha256"),
                        written(F.col("spans"), RULES).alias("spans"))
