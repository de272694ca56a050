"""Filters and search: visibility, eligibility, understood filters, saved searches."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T
from vacantia.functions.text import col
from vacantia.session import materialise, spread


def _strings() -> Column:
    return F.array().cast("array<string>")


# ---------------------------------------------------------------- F1, F2, F17
def visible_postings(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """open postings of enabled boards."""
    on = boards.where(~F.coalesce("disabled", F.lit(False))).select("board")
    return postings.where(F.col("closed_at").isNull()).join(on, "board", "left_semi")


def filter_postings(postings: DataFrame, now: Column, country: str | None = None,
                    remote: bool | None = None, form_readable: bool | None = None,
                    posted_within_days: int | None = None) -> DataFrame:
    """exact-match and recency filters; each reaches the scan."""
    if country is not None:
        postings = postings.where(F.col("country") == country)
    if remote is not None:
        postings = postings.where(F.col("remote") == remote)
    if form_readable is not None:
        postings = postings.where(F.col("form_readable") == form_readable)
    if posted_within_days is not None:
        if not 1 <= posted_within_days <= 365:
            raise ValueError("posted_within_days is 1 to 365")
        postings = postings.where(F.col("posted_at") >= now - F.expr(
            f"interval {int(posted_within_days)} days"))
    return postings


def distinct_companies(postings: DataFrame) -> DataFrame:
    """companies with an open posting."""
    return postings.where(F.col("closed_at").isNull()).select("company").distinct()


# ---------------------------------------------------------------- F3, F4 eligibility
def country_of_profile(country: Column | str, location: Column | str) -> Column:
    """country as recorded, else the last comma part of the location, lower case."""
    last = T.blank_to_null(F.element_at(F.split(col(location), ",", -1), -1))
    return F.lower(F.coalesce(T.blank_to_null(country), last))


def bare_country_of(location: Column | str) -> Column:
    """The name a location consists of, when it is only a name with or without "remote"."""
    low = F.lower(col(location))
    for p in (r"^remote - (.+)$", r"^remote, (.+)$", r"^remote \((.+)\)$",
              r"^(.+) - remote$", r"^(.+), remote$", r"^(.+) \(remote\)$"):
        low = F.regexp_replace(low, p, "$1")
    return low


def country_rules(countries: DataFrame, scopes: DataFrame, world: Iterable[str] = ()) -> DataFrame:
    """F4 per candidate country: scopes that shut it out, its own names, other countries' names.

    ``countries(country)`` is the distinct list of candidate countries and
    ``scopes(scope, country_name)`` the scope table; both are country lists, so
    their size has the number of countries as its bound, not the data.
    """
    names = scopes.groupBy("scope").agg(F.collect_set("country_name").alias("names"))
    table = names.agg(F.collect_list(F.struct("scope", "names"))).scalar()
    everyone = F.array(*[F.lit(w) for w in world]) if world else _strings()
    mine = F.filter("_table", lambda s: F.array_contains(s["names"], F.col("country")))
    other = F.filter("_table", lambda s: ~F.array_contains(s["names"], F.col("country")))

    def flat(c: Column) -> Column:
        return F.flatten(F.transform(c, lambda s: s["names"]))

    return (countries.where(F.col("country").isNotNull()).select("country").distinct()
            .withColumn("_table", table)
            .select("country",
                    F.transform(other, lambda s: s["scope"]).alias("excluded_scopes"),
                    F.array_distinct(F.concat(F.array("country"), flat(mine))).alias("own_names"),
                    F.filter(F.array_distinct(F.concat(flat(other), F.filter(
                        everyone, lambda w: w != F.col("country")))),
                        lambda n: F.length(n) > 3).alias("other_names")))


def scope_table(spark, scopes: Mapping[str, Sequence[str]] = V.SCOPE_COUNTRIES) -> DataFrame:
    """The default scope table as a DataFrame."""
    return spark.createDataFrame([(s, n) for s, ns in scopes.items() for n in ns],
                                 "scope string, country_name string")


def eligible_expr() -> Column:
    """F3 on a row that holds a posting and the rules of one candidate country.

    Subtractive, with every null arm written out: an unstated scope, location or
    country never removes a posting, and no candidate country removes nothing.
    Reads ``bare`` (see ``bare_country_of``), worked out once per posting, not per pair.
    """
    remote = F.coalesce("remote", F.lit(False))
    scope, country = F.col("remote_scope"), F.lower("posting_country")
    open_scope = F.when(
        scope.isNull(),
        F.col("bare").isNull() | ~F.array_contains("other_names", F.col("bare"))
    ).otherwise(~F.array_contains("excluded_scopes", scope))
    near = remote | F.col("posting_country").isNull() | F.array_contains("own_names", country)
    return F.col("own_names").isNull() | ((~remote | open_scope) & near)


def eligible(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """F3 over (candidate, posting) pairs that carry ``candidate_country``.

    Columns read: remote, remote_scope, location, posting_country, candidate_country.
    """
    r = rules.withColumnRenamed("country", "candidate_country")
    if "bare" not in pairs.columns:
        pairs = pairs.withColumn("bare", bare_country_of("location"))
    return (pairs.join(r, "candidate_country", "left").where(eligible_expr())
            .drop("excluded_scopes", "own_names", "other_names", "bare"))


# ---------------------------------------------------------------- F5 apply_filters
def filters_expr(now: Column, places: Sequence = V.REQUEST_PLACES, prefix: str = "f.") -> Column:
    """F5 on a row that holds a posting and a ``filters`` struct.  Title words: see F6."""
    f = lambda n: F.col(prefix + n)
    countries = {label: c for label, _, _, c in places if c}
    place_country = (F.try_element_at(
        F.create_map(*[F.lit(x) for kv in countries.items() for x in kv]), f("place.label"))
        if countries else F.lit(None).cast("string"))
    loc = F.lower(F.coalesce("location", F.lit("")))
    in_place = (F.exists(F.coalesce(f("place.terms"), _strings()), lambda t: F.contains(loc, F.lower(t)))
                | F.coalesce(F.col("country") == place_country, F.lit(False)))
    work = f("workplace")
    has_work = F.coalesce(F.col("workplace") == work, F.lit(False))
    remote_ok = has_work | F.coalesce("remote", F.lit(False))
    since = now - F.make_dt_interval(f("days"))
    have = F.coalesce("skills", _strings())
    return (
        (f("level").isNull() | F.coalesce(F.col("level") == f("level"), F.lit(False)))
        & (f("company").isNull() | F.coalesce(F.col("company") == f("company"), F.lit(False)))
        & (f("days").isNull() | F.coalesce(F.col("posted_at") >= since, F.lit(False)))
        & (work.isNull() | F.when(work == "remote", remote_ok).otherwise(has_work))
        & (F.size(F.array_except(F.coalesce(f("skills"), _strings()), have)) == 0)
        & (f("place").isNull() | in_place))


def apply_filters(pairs: DataFrame, now: Column, places: Sequence = V.REQUEST_PLACES) -> DataFrame:
    """(posting, filters ``f``) rows that pass every filter, all title words included."""
    words = F.coalesce(F.col("f.words"), _strings())
    low = F.lower("title")
    has_words = F.forall(words, lambda w: F.contains(low, F.lower(w)))
    return pairs.where(has_words & filters_expr(now, places))


# ---------------------------------------------------------------- F6 search
def _stems(token: Column) -> Column:
    cut = [F.when(token.rlike(f".{e}$"), F.regexp_replace(token, f"{e}$", ""))
           for e in ("s", "es", "ing")]
    return F.filter(F.array(token, *cut), lambda t: t.isNotNull())


def _title_stems() -> Column:
    """Title words as they stand and without their endings; a plain word matches by equality."""
    tokens = F.filter(F.split(F.lower("title"), "[^a-z0-9]+", -1), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(tokens, _stems)))


#: Parts of a filter, the most selective kinds first; of these a conjunction holds the first ``AT_MOST`` that are stated.
PARTS = ("company", "skills", "words", "place", "days", "level", "workplace")
AT_MOST = 3
#: Of several skills or title words so many are in the conjunction; the others are compared per hit.
OF_SEVERAL = 2
_SEP, _AND = "\u0001", "\u0002"
_PLAIN = "^[a-z0-9]+$"


def _known(c: Column) -> Column:
    return F.filter(F.array(c), lambda v: v.isNotNull())


def _pairs_of(a: Column) -> Column:
    """Every two of a sorted array, as one value each."""
    return F.flatten(F.transform(a, lambda x: F.transform(F.filter(a, lambda y: x < y), lambda y: F.concat(x, F.lit(_AND), y))))


def _filed(searches: DataFrame, now: Column, places: Sequence) -> DataFrame:
    """Distinct filters (``fkey``, candidate_country, f), each with the parts of its conjunction.

    ``sig`` names the kinds of parts, ``values`` their values per kind (several only for days), ``rest`` is the
    filter without what the conjunction decides.
    """
    f = lambda n: F.col("f." + n)
    d = searches.select(_filter_key().alias("fkey"), "candidate_country", "f").dropDuplicates(["fkey"])
    # a word such as "c++" stands in the title under its first letters or digits, and is compared per hit
    runs = F.filter(F.transform(F.coalesce(f("words"), _strings()), lambda w: F.try_element_at(F.filter(
        F.split(F.lower(w), "[^a-z0-9]+", -1), lambda t: t != ""), F.lit(1))), lambda t: t.isNotNull())
    words = F.slice(F.array_sort(F.array_distinct(runs)), 1, OF_SEVERAL)
    skills = F.slice(F.array_sort(F.array_distinct(F.coalesce(f("skills"), _strings()))), 1, OF_SEVERAL)
    days = F.transform(F.sequence(F.to_date(now - F.make_dt_interval(f("days"))), F.to_date(now)), lambda x: F.date_format(x, "yyyy-MM-dd"))
    d = d.withColumn("_place", _place_id(places)).withColumn("_words", words).withColumn("_skills", skills)

    def part(kind: str, values: Column, test: Column) -> Column:
        return F.when(test, F.struct(F.lit(kind).alias("kind"), values.alias("values")))

    def several(kind: str, c: str) -> Column:
        return part(kind, F.array(F.array_join(c, _AND)), F.size(c) > 0)

    stated = [part("company", F.array(f("company")), f("company").isNotNull()), several("skills", "_skills"), several("words", "_words"),
              part("place", F.array(F.col("_place")), f("place").isNotNull()), part("days", days, f("days").isNotNull()),
              part("level", F.array(f("level")), f("level").isNotNull()), part("workplace", F.array(f("workplace")), f("workplace").isNotNull())]
    d = d.withColumn("_parts", F.slice(F.filter(F.array(*stated), lambda p: p.isNotNull()), 1, AT_MOST))
    kinds = F.transform("_parts", lambda p: p["kind"])
    sizes = F.transform(kinds, lambda k: F.when(k == "words", F.concat(k, F.size("_words").cast("string")))
                        .when(k == "skills", F.concat(k, F.size("_skills").cast("string"))).otherwise(k))
    rest = F.col("f")
    for name in ("company", "level", "workplace", "place"):
        rest = rest.withField(name, F.when(~F.array_contains(kinds, F.lit(name)), f(name)))
    plain = F.forall(F.coalesce(f("words"), _strings()), lambda w: F.lower(w).rlike(_PLAIN))
    whole = F.array_contains(kinds, F.lit("words")) & plain & (F.size(F.array_distinct(F.transform(f("words"), lambda w: F.lower(w)))) <= OF_SEVERAL)
    rest = rest.withField("words", F.when(~F.coalesce(whole, F.lit(False)), f("words")).otherwise(_strings()))
    rest = rest.withField("skills", F.when(F.array_contains(kinds, F.lit("skills")), F.array_except(f("skills"), "_skills")).otherwise(f("skills")))
    return d.select("fkey", "candidate_country", "f", F.array_join(sizes, ",").alias("sig"), F.transform("_parts", lambda p: p["values"]).alias("values"), rest.alias("rest"))


def _place_id(places: Sequence) -> Column:
    """A place by what it looks for: its terms and its country."""
    return F.when(F.col("f.place").isNotNull(), F.md5(F.concat_ws(_SEP, F.array_sort(F.array_distinct(F.transform(
        F.coalesce("f.place.terms", _strings()), lambda t: F.lower(t)))), F.coalesce(_place_country(places, "f.place.label"), F.lit("")))))


def _place_country(places: Sequence, label: str) -> Column:
    countries = {name: c for name, _, _, c in places if c}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in countries.items() for x in kv]), F.col(label)) if countries else F.lit(None).cast("string")


def _with_places(postings: DataFrame, searches: DataFrame, places: Sequence) -> DataFrame:
    """``_places``: the places, by id, that a posting is in.

    The distinct locations are cut into all their substrings of a length some term has, so "contains"
    becomes "equals"; the work grows with the number of distinct locations and places.
    """
    wanted = searches.where(F.col("f.place").isNotNull()).select(_place_id(places).alias("id"), F.col("f.place.terms").alias("terms"), _place_country(places, "f.place.label").alias("country")).dropDuplicates(["id"])
    terms = wanted.select("id", F.explode("terms").alias("term")).select("id", F.lower("term").alias("term")).distinct()
    sizes = terms.agg(F.array_sort(F.collect_set(F.length("term")))).scalar()
    loc = postings.where(F.col("location").isNotNull()).select(F.lower("location").alias("loc")).distinct().withColumn("_sizes", sizes)
    cut = loc.select("loc", F.explode("_sizes").alias("n")).where(F.length("loc") >= F.col("n")).select("loc", F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length("loc") - F.col("n") + 1), lambda i: F.substr(F.col("loc"), i, F.col("n"))))).alias("term"))
    by_loc = cut.join(terms, "term").groupBy("loc").agg(F.collect_set("id").alias("_by_loc"))
    by_country = wanted.where(F.col("country").isNotNull()).groupBy("country").agg(F.collect_set("id").alias("_by_country"))
    d = postings.withColumn("_loc", F.lower("location"))
    d = d.join(by_loc.withColumnRenamed("loc", "_loc"), "_loc", "left").drop("_loc")
    d = d.join(by_country.withColumnRenamed("country", "_c"), d["country"] == F.col("_c"), "left").drop("_c")
    return d.withColumn("_places", F.array_union(F.coalesce("_by_loc", _strings()), F.coalesce("_by_country", _strings()))).drop("_by_loc", "_by_country")


def _values_of_posting(kind: str) -> Column:
    """The values under which a posting has a part (reads ``_stems``, ``_places``)."""
    n = int(kind[-1]) if kind[-1].isdigit() else 1
    several = {"words": "_stems", "skills": "skills"}.get(kind.rstrip("12"))
    if several:
        a = F.array_sort(F.array_distinct(F.coalesce(several, _strings())))
        return a if n == 1 else _pairs_of(a)
    if kind == "workplace":
        return F.array_union(_known(F.col("workplace")), _known(F.when(F.col("remote"), F.lit("remote"))))
    return {"company": _known(F.col("company")), "place": F.col("_places"), "level": _known(F.col("level")),
            "days": _known(F.date_format("posted_at", "yyyy-MM-dd"))}[kind]


def _conjunctions(sig: str) -> Column:
    """Every conjunction of these kinds of parts that a posting has."""
    def longer(out: Column, values: Column) -> Column:
        return F.flatten(F.transform(out, lambda x: F.transform(values, lambda y: F.concat(x, F.lit(_SEP), y))))

    return reduce(longer, [F.col(f"_of_{kind}") for kind in sig.split(",") if kind], F.array(F.lit(sig)))


#: What matching reads of a posting.
_READ = ("title", "company", "location", "country", "remote", "remote_scope", "workplace", "level", "skills", "posted_at")


def _filter_key() -> Column:
    country = F.col("candidate_country")
    return F.md5(F.concat_ws(_SEP, T.canonical_json("f"), F.coalesce(country, F.lit("")), country.isNull().cast("string")))


def _hits(postings: DataFrame, searches: DataFrame, now: Column, rules: DataFrame | None, places: Sequence) -> DataFrame:
    """Hits per distinct filter: fkey, posting columns, ``phrase`` (the stricter title test), ``n_words``.

    An index of conjunctions.  Searches of one filter and country are matched once.  Each filter is filed under one
    value made of its (up to three) most selective parts; a posting has such a value for every combination of its
    own that some filter asks for, so both meet by equality on all of these parts at once, and a pair that is met
    is nearly always a hit.  What the value leaves open (further words, the hour of a day) is compared then.
    """
    filters = materialise(_filed(searches, now, places))
    sigs = [r.sig for r in filters.select("sig").distinct().orderBy("sig").collect()]  # kinds of parts: at most a few hundred, whatever the data
    kinds = sorted({k for sig in sigs for k in sig.split(",") if k})
    p = _with_places(postings.withColumn("_stems", _title_stems()), filters, places)
    p = materialise(p.select(*postings.columns, "_stems", bare_country_of("location").alias("bare"), *[_values_of_posting(k).alias(f"_of_{k}") for k in kinds])
                    .withColumn("_row", F.monotonically_increasing_id()))
    mine = filters.select("fkey", "sig", "values")
    for n in range(AT_MOST):
        mine = mine.withColumn(f"_v{n}", F.explode(F.when(F.size("values") > n, F.get("values", F.lit(n))).otherwise(F.array(F.lit(None).cast("string")))))
    mine = mine.select("fkey", F.concat_ws(_SEP, "sig", *[f"_v{n}" for n in range(AT_MOST)]).alias("_key"))
    keyed = p.select("_row", F.explode(F.flatten(F.array(*map(_conjunctions, sigs))) if sigs else _strings()).alias("_key"))
    pairs = spread(mine, "_key").join(keyed, "_key").select("fkey", "_row")  # narrow: what is compared then joins the pairs that met
    d = pairs.join(p.drop(*[f"_of_{k}" for k in kinds]), "_row").join(filters.select("fkey", "candidate_country", "f", "rest"), "fkey")
    words = F.coalesce(F.col("rest.words"), _strings())
    odd = F.filter(words, lambda w: ~w.rlike(_PLAIN))
    all_words = (F.size(F.array_except(F.filter(words, lambda w: w.rlike(_PLAIN)), "_stems")) == 0) & ((F.size(odd) == 0) | T.title_matches("title", odd))
    hits = d.where(all_words & filters_expr(now, places, "rest."))
    if rules is not None:
        r = rules.withColumnRenamed("country", "candidate_country")
        hits = (hits.withColumn("posting_country", F.col("country")).join(r, "candidate_country", "left")
                .where(F.col("f.place").isNotNull() | eligible_expr()))
    asked = F.coalesce(F.col("f.words"), _strings())
    return hits.select("fkey", *postings.columns, F.when(F.size(asked) < 2, True).otherwise(T.title_has_phrase("title", asked)).alias("phrase"), F.size(asked).alias("n_words"))


def search(postings: DataFrame, searches: DataFrame, now: Column,
           rules: DataFrame | None = None, places: Sequence = V.REQUEST_PLACES) -> DataFrame:
    """matching postings per search: the phrase as typed, else all words.

    ``searches(search_id, candidate_country, f)``.  Eligibility applies unless the search names a place.
    """
    hits = _hits(postings, searches, now, rules, places)
    # With fewer than two words the phrase is the word, so only the others need the mode: one aggregate joined back.
    mode = hits.where("n_words >= 2").groupBy("fkey").agg(F.max("phrase").alias("any_phrase"))
    loose = F.coalesce(~F.col("any_phrase"), F.lit(False))
    hits = (hits.join(mode, "fkey", "left").where(F.col("phrase") | loose)
            .withColumn("title_match", F.when(F.col("n_words") == 0, F.lit(None).cast("string")).when(loose, "words").otherwise("phrase")))
    return searches.withColumn("fkey", _filter_key()).join(hits.drop("phrase", "any_phrase", "n_words"), "fkey").drop("fkey")


def search_totals(postings: DataFrame, searches: DataFrame, now: Column, rules: DataFrame | None = None,
                  places: Sequence = V.REQUEST_PLACES, since: str | None = None) -> DataFrame:
    """``searches`` with ``total`` hits and, where a time column is given, how many are first seen after it (``new_count``).

    Hits are counted per distinct filter and day; no (search, posting) row is made.
    """
    s = searches.withColumn("fkey", _filter_key())
    at = F.lit(None) if since is None else F.col("first_seen_at")
    narrow = postings.select(*_READ, *([] if since is None else ["first_seen_at"]))
    hits = _hits(narrow, searches, now, rules, places).groupBy("fkey", at.alias("at"), "phrase").agg(F.count("*").alias("n"))
    hits = materialise(hits)
    mode = hits.groupBy("fkey").agg(F.max("phrase").alias("any_phrase"))
    seen = hits.join(mode, "fkey").where(F.col("phrase") | ~F.col("any_phrase")).groupBy("fkey", "at").agg(F.sum("n").alias("n"))
    if since is None:
        return s.join(seen.withColumnRenamed("n", "total").drop("at"), "fkey", "left").fillna(0, ["total"]).drop("fkey")
    daily = seen.groupBy("fkey", F.to_date("at").alias("day")).agg(F.sum("n").alias("n"))
    asked = s.select("fkey", F.col(since).alias("since")).distinct()
    # per filter a row a day, and the days its searches ask from
    days = daily.unionByName(asked.where("since is not null").select("fkey", F.to_date("since").alias("day"), F.lit(0).cast("bigint").alias("n")))
    days = days.groupBy("fkey", "day").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("fkey").orderBy(F.col("day").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    later = days.withColumn("later", F.coalesce(F.sum("n").over(w), F.lit(0))).select("fkey", "day", "later")
    same = (asked.withColumn("day", F.to_date("since")).join(seen.withColumn("day", F.to_date("at")), ["fkey", "day"])
            .where("at > since").groupBy("fkey", "since").agg(F.sum("n").alias("same")))
    new = (asked.withColumn("day", F.to_date("since")).join(later, ["fkey", "day"]).join(same, ["fkey", "since"], "left")
           .select("fkey", F.col("since").alias(since), (F.col("later") + F.coalesce("same", F.lit(0))).alias("new_count")))
    total = daily.groupBy("fkey").agg(F.sum("n").alias("total"))
    return s.join(total, "fkey", "left").join(new, ["fkey", since], "left").fillna(0, ["total", "new_count"]).drop("fkey")


# ---------------------------------------------------------------- F9, F10
def chips(f: str = "f") -> Column:
    """each understood part of a filter as ``struct<ord, key, label>``."""
    c = lambda n: F.col(f"{f}.{n}")

    def one(i: int, key: str, test: Column, label: Column) -> Column:
        return F.when(test, F.array(F.struct(F.lit(i).alias("ord"), F.lit(key).alias("key"),
                                             label.alias("label"))))

    empty = F.array().cast("array<struct<ord:int,key:string,label:string>>")
    skills = F.transform(F.coalesce(c("skills"), _strings()), lambda s, i: F.struct(
        F.lit(2).alias("ord"), F.concat(F.lit("skill:"), s).alias("key"),
        F.concat(F.lit("skill: "), s).alias("label")))
    parts = [
        one(1, "words", F.size(c("words")) > 0,
            F.concat(F.lit("“"), F.array_join(c("words"), " "), F.lit("” in the title"))),
        skills,
        one(3, "place", c("place").isNotNull(), F.concat(F.lit("in "), c("place.label"))),
        one(4, "workplace", c("workplace").isNotNull(),
            F.when(c("workplace") == "onsite", "on-site").otherwise(c("workplace"))),
        one(5, "level", c("level").isNotNull(), c("level")),
        one(6, "company", c("company").isNotNull(), F.concat(F.lit("at "), c("company"))),
        one(7, "days", c("days").isNotNull(), F.when(c("days") == 1, "posted today").otherwise(
            F.concat(F.lit("posted in the last "), c("days").cast("string"), F.lit(" days")))),
    ]
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def without_part(key: Column | str, f: str = "f") -> Column:
    """the filter with one part taken away."""
    key, c = col(key), F.col(f)
    for name in ("company", "days", "level", "place", "workplace"):
        c = c.withField(name, F.when(key != name, F.col(f"{f}.{name}")))
    c = c.withField("words", F.when(key == "words", _strings()).otherwise(F.col(f"{f}.words")))
    return c.withField("skills", F.filter(F.col(f"{f}.skills"),
                                          lambda s: F.concat(F.lit("skill:"), s) != key))


def loosen(postings: DataFrame, empty_searches: DataFrame, now: Column,
           rules: DataFrame | None = None, places: Sequence = V.REQUEST_PLACES) -> DataFrame:
    """for searches without a hit, the one part whose removal helps most.

    The role words are suggested only when no other part helps.
    """
    tries = (empty_searches.withColumn("chip", F.explode(chips()))
             .withColumn("f", without_part(F.col("chip.key")))
             .withColumn("origin", F.col("search_id"))
             .withColumn("search_id", F.concat_ws("|", "search_id", "chip.ord", "chip.key")))
    totals = search_totals(postings, tries, now, rules, places).where("total > 0").select("origin", "chip", "total")
    best = F.max_by(F.struct("chip", "total"),
                    F.struct((F.col("chip.key") != "words").alias("a"), F.col("total").alias("b"),
                             (-F.col("chip.ord")).alias("c"), F.col("chip.key").alias("d")))
    return (totals.groupBy("origin").agg(best.alias("b"))
            .select(F.col("origin").alias("search_id"), F.col("b.chip.key").alias("key"),
                    F.col("b.chip.label").alias("label"), F.col("b.total").alias("total")))


# ---------------------------------------------------------------- F11-F13 saved searches
def saved_search_counts(searches: DataFrame, postings: DataFrame, now: Column,
                        rules: DataFrame | None = None,
                        places: Sequence = V.REQUEST_PLACES) -> DataFrame:
    """total and new postings per saved search; unreadable filters are flagged."""
    good = searches.where(F.col("f").isNotNull())
    counts = search_totals(postings, good, now, rules, places, since="last_seen_at").select("search_id", "total", "new_count")
    return (searches.select("search_id", F.col("f").isNull().alias("broken"))
            .join(counts, "search_id", "left").fillna(0, ["total", "new_count"]))


def save_searches(events: DataFrame, cap: int = V.MAX_SAVED_SEARCHES) -> DataFrame:
    """one row per (candidate, canonical filters), the earliest; beyond ``cap`` not accepted, with the reason."""
    first = F.min_by(F.struct("search_id", "label", "f", "created_at"),
                     F.struct("created_at", "search_id"))
    one = (events.withColumn("canonical", T.canonical_json("f"))
           .groupBy("candidate_id", "canonical").agg(first.alias("s"))
           .select("candidate_id", "canonical", "s.*"))
    w = Window.partitionBy("candidate_id").orderBy("created_at", "search_id")
    return (one.withColumn("n", F.row_number().over(w)).withColumn("accepted", F.col("n") <= cap)
            .withColumn("reason", F.when(~F.col("accepted"), F.lit("too many saved searches"))))


def mark_seen(searches: DataFrame, events: DataFrame) -> DataFrame:
    """last seen moves to the latest opening of a search, never back."""
    seen = events.groupBy("search_id").agg(F.max("ts").alias("_seen"))
    return (searches.join(seen, "search_id", "left")
            .withColumn("last_seen_at", F.greatest("last_seen_at", "_seen")).drop("_seen"))


# ---------------------------------------------------------------- F14-F16, F18
def new_first(ranked: DataFrame, new_since: Column) -> DataFrame:
    """fresh postings ahead, the ranking kept inside each part."""
    return (ranked.withColumn("is_new", F.coalesce(F.col("first_seen_at") > new_since, F.lit(False)))
            .orderBy(F.col("is_new").desc(), "rank"))


def page(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """a slice in order with the total and whether more follow.

    The slice is a top-(offset+limit) per task merged at the end; the total is a
    separate partial count, so neither gathers the table.
    """
    total = df.agg(F.count("*")).scalar()
    return (df.orderBy(*order).offset(offset).limit(limit)
            .withColumn("total", total)
            .withColumn("has_more", F.col("total") > offset + limit))


def resolve_urls(urls: DataFrame, postings: DataFrame,
                 hosts: Sequence[str] = V.POSTING_HOSTS) -> DataFrame:
    """F16: posting of a page address: unreadable, not indexed, or found with its form state."""
    ref = urls.withColumn("_ref", T.posting_ref("url", hosts)).select(
        *urls.columns, F.col("_ref.board").alias("board"),
        F.col("_ref.external_id").alias("external_id"))
    p = postings.select("board", "external_id", "posting_id", "title", "company",
                        "form_fetched_at", "form_readable")
    return ref.join(p, ["board", "external_id"], "left").withColumn(
        "outcome", F.when(F.col("board").isNull(), "unreadable")
        .when(F.col("posting_id").isNull(), "not indexed").otherwise("found"))


def coverage_notice(ranked: DataFrame, threshold: int = V.LOW_MATCH) -> DataFrame:
    """candidates whose best score is below the threshold."""
    return (ranked.groupBy("candidate_id").agg(F.max("score").alias("best_match"))
            .where(F.col("best_match") < threshold))
