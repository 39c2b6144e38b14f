"""Review of results: components, health, item scores, claim order, unions of rule outputs, greedy units, run manifests."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.functions import text as T


def component_summary(parts: DataFrame, key: str, entry: str) -> DataFrame:
    """(key, entries, identity_confirmed, content_confirmed, temporal_pending, invalid_format, not_found, mismatch, unverified) from parts(key, entry, step, status).

    An entry's identity is confirmed if its existence is and its article is or was not cited; of the failures of an entry
    the first in the order above counts.
    """
    is_ = lambda step, *status: F.bool_or((F.col("step") == step) & F.col("status").isin(*status))
    any_ = lambda status: F.bool_or(F.col("status") == status)
    e = parts.groupBy(key, entry).agg(
        (F.coalesce(is_("existence", "CONFIRMED"), F.lit(False)) & F.coalesce(is_("article", "CONFIRMED", "NOT_APPLICABLE"), F.lit(False))).alias("known"),
        F.bool_or((F.col("step") == "temporal") & (F.col("status") != "CONFIRMED")).alias("pending"), is_("content", "CONFIRMED", "NOT_APPLICABLE").alias("content"),
        any_("INVALID_FORMAT").alias("invalid"), any_("NOT_FOUND").alias("missing"), any_("MISMATCH").alias("differs"),
    )
    known, invalid, missing, differs = (F.coalesce(F.col(c), F.lit(False)) for c in ("known", "invalid", "missing", "differs"))
    return e.groupBy(key).agg(
        F.count("*").alias("entries"), F.count_if(known).alias("identity_confirmed"), F.count_if(known & F.col("content") & ~differs).alias("content_confirmed"), F.count_if(known & F.col("pending")).alias("temporal_pending"),
        F.count_if(invalid).alias("invalid_format"), F.count_if(missing & ~invalid).alias("not_found"), F.count_if(differs & ~missing & ~invalid).alias("mismatch"), F.count_if(~known & ~differs & ~missing & ~invalid).alias("unverified"),
    )


def source_health(calls: DataFrame, key: str, status: str) -> DataFrame:
    """(key, calls, errors, throttled, states): calls by status; anything but 200 is an error. states lists status=count, of which there are few."""
    by = calls.groupBy(key, status).agg(F.count("*").alias("n"))
    states = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(status, "n"))), lambda x: F.concat_ws("=", x[status].cast("string"), x["n"].cast("string"))), ",")
    some = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return by.groupBy(key).agg(F.sum("n").alias("calls"), some(F.col(status) != 200).alias("errors"), some(F.col(status) == 429).alias("throttled"), states.alias("states"))


def item_scores(items: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """(key, recall, precision, tp, fp, traps, duplicates): items(key, item, trap, weight) against findings(key, item), whose item may be null.

    Recall is weighted and leaves traps out; a finding is right if it names an item that is no trap; each further one for
    the same item is a duplicate too. Null where nothing is there to divide by.
    """
    hits = findings.filter("item is not null").groupBy(key, "item").agg(F.count("*").alias("hits"))
    lost = findings.join(items.select(key, "item").distinct(), [key, "item"], "left_anti").groupBy(key).agg(F.count("*").alias("lost"))
    j = items.join(hits, [key, "item"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    real = ~F.col("trap")
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, what)), F.lit(0))
    g = j.groupBy(key).agg(
        total(real & (F.col("hits") > 0), F.col("weight")).alias("got"), total(real, F.col("weight")).alias("all"), total(real, F.col("hits")).alias("tp"), total(~real, F.col("hits")).alias("traps"),
        total(real & (F.col("hits") > 1), F.col("hits") - 1).alias("duplicates"),
    )
    g = g.join(lost, key, "full_outer").fillna(0, ["got", "all", "tp", "traps", "duplicates", "lost"]).withColumn("fp", F.col("traps") + F.col("lost"))
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 4)
    return g.select(key, share(F.col("got"), F.col("all")).alias("recall"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), "tp", "fp", "traps", "duplicates")


def claim_tier(cited: Column, kind: Column, valued: Column, text: Column) -> Column:
    """1 cited, 2 legal or with a value, 5 under 15 characters, 3 a fact, 4 anything else."""
    short = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "")) < 15
    return F.when(cited, 1).when(kind.isin("LEGAL_RULE", "LEGAL_ARGUMENT") | valued, 2).when(short, 5).when(kind == "FACT", 3).otherwise(4)


def name_scores(names: DataFrame, key: str, name: str, counts: list[tuple[str, int]]) -> DataFrame:
    """(key, score, n_matched): the words of one text, the 80 most frequent with their counts, that a name holds: sum of (1 + ln count) * length."""
    top = sorted(counts, key=lambda c: (-c[1], c[0]))[:80]
    words = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(c).alias("c")) for w, c in top))
    hit = F.filter(words, lambda x: F.lower(name).contains(x["w"]))
    score = F.aggregate(hit, F.lit(0.0), lambda s, x: s + (1 + F.log(x["c"])) * F.length(x["w"]))
    return names.select(key, F.round(score, 3).alias("score"), F.size(hit).alias("n_matched")).filter("n_matched > 0")


def union_outputs(outputs: dict[str, DataFrame], key: str) -> tuple[DataFrame, DataFrame]:
    """All findings(key, rule, value) of the engines with their name, and per (key, rule) the value of the first engine that has one."""
    rows = None
    for order, (engine, df) in enumerate(outputs.items()):
        part = df.select(F.lit(engine).alias("engine"), F.lit(order).alias("_order"), key, "rule", "value")
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy(key, "rule").agg(F.min(F.struct("_order", "engine", "value")).alias("f"))
    return rows.drop("_order"), first.select(key, "rule", "f.engine", "f.value")


def greedy_units(docs: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, unit, first_block, n_blocks, n_sentences): lines joined until they hold `least` sentences, then anew; blank lines are left out.

    One pass over the sentence counts of a text's own lines, inside its row.
    """
    lines = F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("i"), F.size(T.sentences(t)).alias("n"), F.trim(t).alias("t")))
    unit = "struct<first_block:int,n_blocks:int,n_sentences:int>"

    def step(s, x):
        u = F.struct(F.coalesce(s["open"]["first_block"], x["i"]).alias("first_block"), (F.coalesce(s["open"]["n_blocks"], F.lit(0)) + 1).alias("n_blocks"), (F.coalesce(s["open"]["n_sentences"], F.lit(0)) + x["n"]).alias("n_sentences"))
        none = F.lit(None).cast(unit)
        full = F.struct(F.concat(s["done"], F.array(u)).alias("done"), none.alias("open"))
        more = F.struct(s["done"].alias("done"), u.alias("open"))
        return F.when(u["n_sentences"] >= least, full).otherwise(more)

    start = F.struct(F.expr(f"cast(array() as array<{unit}>)").alias("done"), F.lit(None).cast(unit).alias("open"))
    out = F.aggregate(F.filter(lines, lambda x: x["t"] != ""), start, step, lambda s: F.when(s["open"].isNotNull(), F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
    return docs.select("doc_id", F.posexplode(out).alias("unit", "u")).select("doc_id", "unit", "u.*")


def json_leaves(column: str):
    """array<path, value> of every leaf of a JSON text; empty containers are leaves, a text that is no JSON has none."""

    @F.pandas_udf("array<struct<path:string,value:string>>")
    def leaves(texts: pd.Series) -> pd.Series:
        import json

        def walk(v, path):
            if isinstance(v, dict) and v:
                for k, x in v.items():
                    yield from walk(x, f"{path}.{k}" if path else k)
            elif isinstance(v, list) and v:
                for i, x in enumerate(v):
                    yield from walk(x, f"{path}[{i}]")
            else:
                yield {"path": path, "value": v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}

        def one(t):
            try:
                return list(walk(json.loads(t), ""))
            except (TypeError, ValueError):
                return []

        return texts.map(one)

    return leaves(column)


def shareable(column: str, names: str, kinds: dict[str, str], drop: tuple[str, ...] = ()):
    """A JSON text whose string leaves lose the names (an array column), longest first, and the kinds of personal data; members named in drop go.

    Keys stay. A text that is no JSON gives null.
    """

    @F.pandas_udf("string")
    def mask(texts: pd.Series, known: pd.Series) -> pd.Series:
        import json
        import re

        compiled = [(k, re.compile(p)) for k, p in kinds.items()]

        def walk(v, names):
            if isinstance(v, dict):
                return {k: walk(x, names) for k, x in v.items() if k not in drop}
            if isinstance(v, list):
                return [walk(x, names) for x in v]
            if not isinstance(v, str):
                return v
            for n in names:
                v = v.replace(n, "[name]")
            for k, p in compiled:
                v = p.sub(f"[{k}]", v)
            return v

        def one(t, ns):
            try:
                own = sorted({n for n in (() if ns is None else ns) if n and len(n) > 1}, key=lambda n: (-len(n), n))
                return json.dumps(walk(json.loads(t), own), ensure_ascii=False, separators=(",", ":"))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(t, n) for t, n in zip(texts, known)], dtype=object)

    return mask(column, names)


class RunManifest:
    """What each stage of a run read, returned, skipped or failed at, and how long it took.

    Rows are counted as they flow: an observation on both ends of a stage, no second pass.
    """

    def __init__(self, spark):
        self.spark, self.rows = spark, []

    def stage(self, name: str, fn: Callable[[DataFrame], DataFrame], df: DataFrame, write: Callable[[DataFrame], DataFrame], skip: str | None = None) -> DataFrame:
        """fn(df) as `write` stores it and gives it back; a skipped stage passes df on. An error is noted and raised."""
        import time

        from pyspark.sql import Observation

        if skip:
            self.rows.append((name, None, None, None, skip, None))
            return df
        seen, made, start = Observation(), Observation(), time.time()
        try:
            out = write(fn(df.observe(seen, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n")))
        except Exception as e:
            self.rows.append((name, None, None, time.time() - start, None, type(e).__name__))
            raise
        self.rows.append((name, seen.get["n"], made.get["n"], time.time() - start, None, None))
        return out

    def table(self) -> DataFrame:
        """(position, stage, inputs, outputs, seconds, skipped, error) of the stages so far."""
        schema = "position int, stage string, inputs long, outputs long, seconds double, skipped string, error string"
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(self.rows)], schema)
