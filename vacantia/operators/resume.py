"""Resume text to a structured profile, over a documents table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import fixed_values as V
from vacantia.functions import text as T

SEPARATOR = r"\s+[-–—|·]\s+"
ROLE = "struct<title:string,company:string,location:string,start:string,end:string,dated:string,bullets:array<string>>"


def resume_lines(text: Column | str) -> Column:
    """Trimmed lines that are not blank."""
    flat = F.regexp_replace(T.col(text), r"\r\n?", "\n")
    return F.filter(F.transform(F.split(flat, "\n", -1), T.trim_ws), lambda x: x != "")


def _field(values: Column, many: str) -> Column:
    """``struct<value, confidence, alternatives>``: one is high, several medium, none low."""
    n = F.size(values)
    return F.struct(
        F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")).alias("value"),
        F.when(n == 1, "high").when(n > 1, many).otherwise("low").alias("confidence"),
        F.when(n > 1, values).alias("alternatives"))


def emails(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(T.col(text), F.lit(V.EMAIL), 0))


def phones(text: Column | str) -> Column:
    """Number runs of 8 to 15 digits that are not a range of years."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(T.col(text), F.lit(V.PHONE), 0), T.trim_ws))
    digits = lambda p: F.length(F.regexp_replace(p, r"\D", ""))
    return F.filter(found, lambda p: digits(p).between(8, 15) & ~p.rlike(V.YEAR_RANGE))


def contacts(text: Column | str) -> Column:
    """Email, phone and profile link with a confidence each."""
    link = F.regexp_extract(T.col(text), V.PROFILE_LINK, 0)
    full = F.when(link.startswith("http"), link).otherwise(F.concat(F.lit("https://"), link))
    return F.struct(
        _field(emails(text), "medium").alias("email"), _field(phones(text), "medium").alias("phone"),
        _field(F.when(link != "", F.array(full)).otherwise(F.array().cast("array<string>")), "medium")
        .alias("link"))


def is_place(c: Column) -> Column:
    return (c.rlike(r"^[\p{L} .'-]+,[\p{L} ,.'-]+$") & (F.length(c) < 80) & ~c.contains("@")
            & ~c.rlike(r"\d"))


def _heading(c: Column, *kinds: str) -> Column:
    return c.rlike(T.any_of(V.SECTION_HEADS[k] for k in (kinds or V.SECTION_HEADS)))


def name_title_location(lines: Column | str) -> Column:
    """R2: name from the first line, title from the next three, place from the first six."""
    lines = T.col(lines)
    first = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))
    named = (first.rlike(r"^\p{L}[\p{L}'.\- ]{1,48}$") & (F.size(F.split(first, r"\s+", -1)) <= 4)
             & ~first.rlike(V.EMAIL))
    parts = F.split(first, r"\s+", -1)
    contact = lambda c: (c.contains("@") | c.rlike(r"(?i)linkedin\.com|https?://|www\.")
                         | c.rlike(r"\d{5,}|\+\d") | (F.size(F.split(c, SEPARATOR, -1)) > 2))
    title = F.try_element_at(F.filter(F.slice(lines, 2, 3), lambda c: ~contact(c) & ~_heading(c)
                                      & (F.length(c) < 60) & ~c.rlike(V.DATE_RANGE) & ~is_place(c)), F.lit(1))
    segments = F.flatten(F.transform(F.slice(lines, 1, 6), lambda c: F.split(c, SEPARATOR, -1)))
    place = F.try_element_at(F.filter(F.transform(segments, T.trim_ws), is_place), F.lit(1))
    return F.struct(
        F.when(named, F.element_at(parts, 1)).alias("first_name"),
        F.when(named & (F.size(parts) > 1), F.array_join(F.slice(parts, 2, 10), " ")).alias("last_name"),
        F.when(named, title).alias("title"), place.alias("location"))


def section(lines: Column | str, start: str, ends: Iterable[str]) -> Column:
    """Lines after the first heading of one kind, up to the next heading of ``ends``."""
    lines = T.col(lines)
    at = F.array_position(F.transform(lines, lambda c: _heading(c, start)), True).cast("int")
    after = F.slice(lines, at + 1, F.greatest(F.size(lines), F.lit(1)))
    stop = F.array_position(F.transform(after, lambda c: _heading(c, *ends)), True).cast("int")
    body = F.when(stop > 0, F.slice(after, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(after)
    return F.when(at > 0, body)


def sections(lines: Column | str) -> Column:
    """The skills and the experience block; null where there is no such heading."""
    return F.struct(section(lines, "skills", ("experience", "education", "other")).alias("skills"),
                    section(lines, "experience", ("education", "other", "skills")).alias("experience"))


def skills_block(block: Column | str, vocab: Iterable[str]) -> Column:
    """Skills of the block; known to the vocabulary is high, the rest low."""
    vocab = list(vocab)
    parts = F.transform(F.split(F.array_join(T.col(block), " "), r"[,;|·•]|\s-\s", -1),
                        lambda s: F.lower(T.trim_ws(s)))
    kept = F.filter(F.array_distinct(parts), lambda s: (F.length(s) > 1) & (F.length(s) < 40))
    return F.transform(kept, lambda s: F.struct(
        s.alias("value"),
        F.when(F.array_contains(T.terms_in(s, vocab), s), "high").otherwise("low").alias("confidence")))


def _role_heading(line: Column) -> Column:
    """A "title, company [— place]" line as a role, or null."""
    tail = T.trim_ws(F.regexp_extract(line, r"\s+[—–|]\s+([^—–|]+)$", 1))
    placed = ((tail != "") & tail.rlike(r"^[\p{L} .'-]+(,[\p{L} .'-]+)*$")
              & (F.size(F.split(tail, r"\s+", -1)) <= 4)
              & ~tail.rlike(r"(?i)^(inc|ltd|llc|pvt|gmbh|corp|co|plc|limited|remote team)\.?$"))
    head = F.when(placed, F.regexp_replace(line, r"\s+[—–|]\s+[^—–|]+$", "")).otherwise(line)
    parts = F.filter(F.transform(F.split(head, r"\s*,\s*|\s+at\s+|\s*[—–|]\s*", -1), T.trim_ws),
                     lambda s: s != "")
    return F.when((F.size(parts) >= 2) & (F.length(head) < 90), F.struct(
        F.element_at(parts, 1).alias("title"),
        F.array_join(F.slice(parts, 2, 90), ", ").alias("company"),
        F.when(placed, tail).alias("location"), F.lit(None).cast("string").alias("start"),
        F.lit(None).cast("string").alias("end"), F.lit(None).cast("string").alias("dated"),
        F.array().cast("array<string>").alias("bullets")))


def roles(block: Column | str) -> Column:
    """Roles of the experience block: an ordered fold over its lines, inside the row.

    ``dated`` is null without a date range, "sure", or "guess" for two-digit years;
    an ongoing role has a start, no end and a ``dated`` mark.
    """
    empty = F.array().cast(f"array<{ROLE}>")

    def step(acc: Column, line: Column) -> Column:
        n = F.size(acc)
        last = F.try_element_at(acc, F.greatest(n, F.lit(1)))
        rest = F.slice(acc, 1, F.greatest(n - 1, F.lit(0)))
        bullet = T.trim_ws(F.regexp_replace(line, V.RESUME_BULLET, ""))
        with_bullet = last.withField("bullets", F.concat(last["bullets"], F.array(bullet)))
        start = F.regexp_extract(line, V.DATE_RANGE, 1)
        end = F.regexp_extract(line, V.DATE_RANGE, 2)
        guess = F.when(line.rlike(V.SHORT_YEARS), "guess").otherwise("sure")
        with_dates = (last.withField("start", start)
                      .withField("end", F.when(~end.rlike("(?i)present|current|now"), end))
                      .withField("dated", guess))
        new = _role_heading(line)
        return (F.when(line.rlike(V.RESUME_BULLET),
                       F.when(n > 0, F.concat(rest, F.array(with_bullet))).otherwise(acc))
                .when((start != "") & (n > 0), F.concat(rest, F.array(with_dates)))
                .when(new.isNotNull(), F.concat(acc, F.array(new))).otherwise(acc)).cast(f"array<{ROLE}>")

    return F.aggregate(F.coalesce(T.col(block), F.array().cast("array<string>")), empty, step)


def excluded_sensitive(text: Column | str) -> Column:
    """Names of attributes that were found and are never kept."""
    text = T.col(text)
    return F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in V.EXCLUDED_ATTRIBUTES]),
                    lambda x: x.isNotNull())


def parse_resumes(docs: DataFrame, vocab: Iterable[str], text: str = "text") -> DataFrame:
    """R1-R7 in one pass: no shuffle, each text read once."""
    d = (docs.withColumn("_lines", resume_lines(text)).withColumn("contacts", contacts(text))
         .withColumn("who", name_title_location("_lines")).withColumn("_s", sections("_lines"))
         .withColumn("skills", F.when(F.col("_s.skills").isNotNull(), skills_block(F.col("_s.skills"), vocab)))
         .withColumn("roles", roles(F.col("_s.experience")))
         .withColumn("excluded", excluded_sensitive(text)))
    n_roles = F.size("roles")
    warnings = F.filter(F.array(
        F.when(F.length(T.trim_ws(text)) < 120, "almost no text"),
        F.when(F.col("_s.skills").isNull(), "no skills section"),
        F.when(F.col("_s.experience").isNull(), "no experience section"),
        F.when(F.col("_s.experience").isNotNull() & (n_roles == 0), "no roles found")),
        lambda w: w.isNotNull())
    return d.withColumn("warnings", warnings).drop("_lines", "_s")


def review_counts(parsed: DataFrame) -> DataFrame:
    """Fields found and fields a person has to look at (confidence below high)."""
    low = lambda c: F.when(c != "high", 1).otherwise(0)
    skills = F.coalesce("skills", F.array().cast("array<struct<value:string,confidence:string>>"))
    contact = sum((low(F.col(f"contacts.{n}.confidence")) for n in ("email", "phone", "link")), F.lit(0))
    unsure_skills = F.size(F.filter(skills, lambda s: s["confidence"] != "high"))
    n_roles = F.coalesce(F.greatest(F.size("roles"), F.lit(0)), F.lit(0))
    undated = F.size(F.filter("roles", lambda r: F.coalesce(r["dated"], F.lit("")) != "sure"))
    bullets = F.coalesce(F.aggregate("roles", F.lit(0), lambda n, r: n + F.size(r["bullets"])), F.lit(0))
    # Name, surname, place and title are never more than a reading; title and company of
    # a role neither; its two dates are sure or not together; lines are sure.
    return (parsed.withColumn("field_count", 7 + F.size(skills) + 4 * n_roles + bullets)
            .withColumn("needs_review", 4 + contact + unsure_skills + 2 * n_roles + 2 * F.coalesce(F.greatest(undated, F.lit(0)), F.lit(0))))
