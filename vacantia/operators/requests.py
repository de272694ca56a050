"""Free-text requests: slots per message and the filters of a conversation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T
from vacantia.operators.sequence import carry_forward

# An ASCII word edge; Java's own \b also counts letters such as "ï".
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


#: What ``trim_ws`` may find at an end of a text without runs of white space; Java's ``$`` also stands before a last line end.
_ENDS = (" ", "\u00a0", "\u0085", "\u2028", "\u2029")


def _ascii(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def _drop_first(t: Column, pattern: Column | str) -> Column:
    """Replace the first occurrence of a pattern by a space."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.regexp_replace(t, F.concat(F.lit("(?s)^(.*?)(?:"), p, F.lit(")")), F.lit("$1 "))


def _strings() -> Column:
    return F.array().cast("array<string>")


def literals(pattern: str) -> list[str] | None:
    """Pieces of which a text holds one wherever ``pattern``, a list of words between word edges, is found; None: not known."""
    m = re.fullmatch(r"\\b(?:\((.*)\)|([a-z0-9 ]+))\\b", pattern)
    if not m or "(?" in pattern or "{" in pattern:
        return None
    out, runs, run, depth = [], [], "", 0
    for i, x in enumerate(inner := (m[1] or m[2]) + "|"):
        plain = depth == 0 and re.fullmatch("[a-z0-9 ]", x) and inner[i - 1:i] != "\\"
        if plain and inner[i + 1] not in "?*":
            run += x
            continue
        runs, run = [*runs, run], ""
        depth += (x in "([") - (x in ")]")
        if depth < 0 or x == "\\":
            return None
        if x == "|" and depth == 0:
            out, runs = [*out, max(runs, key=len)], []
    return out if depth == 0 and all(out) else None


def _found(t: Column, pattern: str) -> Column:
    """Whether the pattern is found; texts without any of its literal pieces, which most are, are not searched."""
    hit, parts = t.rlike(_ascii(pattern)), literals(pattern)
    return hit if parts is None else reduce(or_, [F.contains(t, F.lit(x)) for x in parts]) & hit


def _take_rules(df: DataFrame, name: str, rules: Iterable[tuple], cast: str) -> DataFrame:
    """First rule found in the working text gives the slot; its words leave the text."""
    rules = list(rules)
    value = None
    for v, p in rules:
        hit, v = _found(F.col("_t"), p), F.lit(v).cast(cast)
        value = F.when(hit, v) if value is None else value.when(hit, v)
    df = df.withColumn(name, F.coalesce(F.col(name), value) if name in df.columns else value)
    gone = None
    for v, p in rules:
        cut = F.regexp_replace("_t", _ascii(p), " ")
        test = (F.col(name) == F.lit(v)) & _found(F.col("_t"), p)
        gone = F.when(test, cut) if gone is None else gone.when(test, cut)
    return df.withColumn("_t", gone.otherwise(F.col("_t")))


def parse_requests(messages: DataFrame, companies: DataFrame | None, vocab: Iterable[str],
                   places: Sequence = V.REQUEST_PLACES, id_col: str = "msg_id") -> DataFrame:
    """``messages(msg_id, text)`` to slots, notes, ignored words and two flags.

    Slots a message does not name are null.  Parts are taken from the working
    text in a fixed order, each before the next is looked for.
    """
    df = messages.withColumn("_t", F.regexp_replace(F.replace(F.lower("text"), F.lit("’"), F.lit("'")), r"\s+", " "))
    edged = F.left("_t", F.lit(1)).isin(*_ENDS) | F.right("_t", F.lit(1)).isin(*_ENDS)
    df = df.withColumn("_t", F.concat(F.lit(" "), F.when(edged, T.trim_ws("_t")).otherwise(F.col("_t")), F.lit(" ")))

    reset = _ascii(V.REQUEST_RESET)
    df = df.withColumn("asks_reset", _found(F.col("_t"), V.REQUEST_RESET))
    df = df.withColumn("_t", F.when(F.col("asks_reset"), _drop_first(F.col("_t"), reset))
                       .otherwise(F.col("_t")))
    df = df.withColumn("refining", F.col("_t").rlike(_ascii(V.REQUEST_REFINE)))

    notes = [F.when(_found(F.col("_t"), p), F.lit(n)) for n, p in V.REQUEST_CANNOT]
    df = df.withColumn("notes", F.filter(F.array(*notes), lambda n: n.isNotNull()))
    df = df.withColumn("_t", F.when(F.size("notes") > 0, F.regexp_replace(
        "_t", _ascii(T.any_of(p for _, p in V.REQUEST_CANNOT)), " ")).otherwise(F.col("_t")))

    n_days = _ascii(r"\b(\d{1,3}) days?\b")
    stated = F.when(F.contains("_t", F.lit(" day")), F.nullif(F.regexp_extract("_t", n_days, 1), F.lit("")).cast("int"))
    df = df.withColumn("days", F.when(stated > 365, 365).otherwise(stated)).withColumn("_stated", stated.isNotNull())
    df = df.withColumn("_t", F.when(F.col("_stated"), _drop_first(F.col("_t"), n_days))
                       .otherwise(F.col("_t")))
    worded = _take_rules(df.withColumn("_kept", F.col("_t")).withColumn("_d", F.lit(None).cast("int")),
                         "_d", V.REQUEST_DAYS, "int")
    df = (worded.withColumn("days", F.coalesce("days", "_d"))
          .withColumn("_t", F.when(F.col("_stated"), F.col("_kept")).otherwise(F.col("_t")))
          .drop("_kept", "_d", "_stated"))
    df = _take_rules(df, "workplace", V.REQUEST_WORKPLACES, "string")
    df = _take_rules(df, "level", V.REQUEST_LEVELS, "string")

    if places:
        spellings = sorted(((s, p) for p in places for s in p[1]), key=lambda x: -len(x[0]))
        said = None
        for spelling, _ in spellings:
            hit = F.contains("_t", F.lit(spelling)) & F.col("_t").rlike(rf"(^|[^a-z]){T.re.escape(spelling)}($|[^a-z])")
            said = F.when(hit, F.lit(spelling)) if said is None else said.when(hit, F.lit(spelling))
        df = df.withColumn("_say", said)
        label = F.create_map(*[F.lit(x) for s, p in spellings for x in (s, p[0])])
        terms = F.create_map(*[x for p in places for x in
                               (F.lit(p[0]), F.array(*[F.lit(t) for t in p[2]]))])
        lab = F.try_element_at(label, F.col("_say"))
        df = df.withColumn("place", F.when(F.col("_say").isNotNull(), F.struct(
            lab.alias("label"), F.try_element_at(terms, lab).alias("terms"))))
        cut = _drop_first(F.col("_t"), F.concat(F.lit("(?:^|[^a-z])"), T.quote_regex(F.col("_say")),
                                                F.lit("(?:$|[^a-z])")))
        df = df.withColumn("_t", F.when(F.col("_say").isNotNull(), cut).otherwise(F.col("_t")))
        df = df.drop("_say")
    else:
        df = df.withColumn("place", F.lit(None).cast("struct<label:string,terms:array<string>>"))

    if companies is not None:
        df = _take_company(df, companies, id_col)
    else:
        df = df.withColumn("company", F.lit(None).cast("string"))

    vocab = [v for v in vocab if v]
    skills = T.terms_in("_t", vocab)
    if vocab:
        skills = F.when(reduce(or_, [F.contains(F.lower("_t"), F.lit(v.lower())) for v in vocab]), skills).otherwise(
            F.when(F.col("_t").isNotNull(), _strings()))
    df = df.withColumn("_skills", skills)
    longest = F.array_sort("_skills", lambda a, b: F.length(b) - F.length(a))
    df = df.withColumn("_t", F.aggregate(
        longest, F.col("_t"), lambda t, s: _drop_first(t, T.quote_regex(s))))
    df = df.withColumn("skills", F.when(F.size("_skills") > 0, F.col("_skills")))

    stop = F.array(*[F.lit(w) for w in V.REQUEST_STOP_WORDS])
    words = F.filter(F.split("_t", "[^a-z0-9+#.]+", -1), lambda w: F.length(w) >= 2)
    df = df.withColumn("_w", words)
    kept = F.filter(F.array_except("_w", stop), lambda w: ~w.rlike(r"^\d+$"))
    df = df.withColumn("words", F.when(F.size(kept) > 0, kept))
    df = df.withColumn("ignored", F.array_intersect("_w", stop))
    return df.drop("_t", "_w", "_skills")


def _take_company(df: DataFrame, companies: DataFrame, id_col: str) -> DataFrame:
    """The longest company name a message holds, found by joining word runs to company keys."""
    keys = (companies.select("company", T.company_key("company").alias("_key"))
            .where(F.length("_key") >= 3)
            .withColumn("_n", F.size(F.regexp_extract_all("_key", F.lit("[a-z]+|[^a-z]"), 0))))
    sizes = keys.agg(F.array_sort(F.collect_set("_n"))).scalar()
    runs = F.regexp_extract_all("_t", F.lit("[a-z]+|[^a-z]"), 0)
    is_word = lambda x: x.rlike("^[a-z]")
    # Token runs of the lengths some key has, starting and ending at a letter edge.
    grams = (
        df.select(id_col, runs.alias("_r")).withColumn("_sizes", sizes)
        .select(id_col, "_r", F.explode("_sizes").alias("_n"))
        .where(F.size("_r") >= F.col("_n"))
        .select(id_col, F.explode(F.transform(
            F.sequence(F.lit(1), F.size("_r") - F.col("_n") + 1),
            lambda i: F.struct(
                F.slice("_r", i, F.col("_n")).alias("g"),
                F.try_element_at("_r", F.when(i > 1, i - 1).otherwise(F.size("_r") + 1)).alias("b"),
                F.try_element_at("_r", i + F.col("_n")).alias("a")))).alias("_x"))
        .where(~(F.coalesce(is_word(F.col("_x.b")), F.lit(False)))
               & ~(F.coalesce(is_word(F.col("_x.a")), F.lit(False))))
        .select(id_col, F.array_join("_x.g", "").alias("_key")).distinct())
    best = (grams.join(keys, "_key").groupBy(id_col)
            .agg(F.min_by(F.struct("company", "_key"),
                          F.struct((-F.length("company")).alias("l"), "company")).alias("_c")))
    df = df.join(best, id_col, "left").withColumn("company", F.col("_c.company"))
    cut = _drop_first(F.col("_t"), F.concat(F.lit("(?:^|[^a-z])"), T.quote_regex(F.col("_c._key")),
                                            F.lit("(?:$|[^a-z])")))
    return df.withColumn("_t", F.when(F.col("company").isNotNull(), cut).otherwise(F.col("_t"))).drop("_c")


SLOTS = ("words", "place", "workplace", "level", "company", "days")


def fold_conversation(parsed: DataFrame, conv: str = "conv_id", turn: str = "turn",
                      chunk: int = 4096) -> DataFrame:
    """F8: filters after each turn, with the reset and unchanged flags.

    Whether a turn starts afresh depends on its own message only, so the fold is
    "last value since the last fresh turn" per slot; skills add up inside a run.
    """
    named = sum(F.col(c).isNotNull().cast("int")
                for c in ("place", "workplace", "level", "company", "days", "skills"))
    first = parsed.groupBy(conv).agg(F.min(turn).alias("_first"))
    fresh = F.col("asks_reset") | (~F.col("refining") & F.col("words").isNotNull() & (named > 0))
    d = (parsed.join(first, conv)
         .withColumn("_is_first", F.col(turn) == F.col("_first"))
         .withColumn("_fresh", fresh | F.col("_is_first")).drop("_first"))
    d = carry_forward(d, conv, turn, "_fresh", SLOTS, chunk)
    # A run's skills with the turn they came in: as many as the vocabulary at most.
    came = (d.where(F.col("skills").isNotNull())
            .select(conv, "seg", turn, F.posexplode("skills").alias("_i", "_s"))
            .groupBy(conv, "seg", "_s").agg(F.min(F.struct(turn, "_i")).alias("_at"))
            .groupBy(conv, "seg").agg(F.array_sort(F.collect_list(
                F.struct(F.col(f"_at.{turn}").alias("t"), F.col("_at._i").alias("i"),
                         F.col("_s").alias("s")))).alias("_came")))
    d = d.join(came, [conv, "seg"], "left")
    mine = F.coalesce(F.filter("_came", lambda x: x["t"] <= F.col(turn)),
                      F.array().cast("array<struct<t:bigint,i:int,s:string>>"))
    older = F.coalesce(F.filter("_came", lambda x: x["t"] < F.col(turn)),
                       F.array().cast("array<struct<t:bigint,i:int,s:string>>"))
    same = F.lit(True)
    for c in SLOTS:
        same = same & F.col("cur_" + c).eqNullSafe(F.col("prev_" + c))
    filters = F.struct(
        F.col("cur_company").alias("company"), F.col("cur_days").alias("days"),
        F.col("cur_level").alias("level"), F.col("cur_place").alias("place"),
        F.transform(mine, lambda x: x["s"]).alias("skills"),
        F.coalesce("cur_words", _strings()).alias("words"),
        F.col("cur_workplace").alias("workplace"))
    reset = F.col("_fresh") & ~F.col("_is_first")
    return d.select(
        conv, turn, filters.alias("f"), reset.alias("reset"),
        (~reset & ~F.col("_is_first") & same & (F.size(mine) == F.size(older))).alias("unchanged"),
        "notes", "ignored")
