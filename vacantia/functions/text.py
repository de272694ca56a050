"""Text and label functions: Column in, Column out, all built-in expressions.

Java's ``\\w`` is ASCII while its ``\\b`` is not, so word edges over free text are
written as look-arounds on ``\\w``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import fixed_values as V


# ---------------------------------------------------------------- small helpers
def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` over a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word(alternatives: str) -> str:
    """A pattern for any of the alternatives as whole words."""
    return rf"(?<!\w)(?:{alternatives})(?!\w)"


def trim_ws(c: Column | str) -> Column:
    """Strip every kind of leading and trailing white space."""
    return F.regexp_replace(col(c), r"^[\s\u00a0]++|(?<![\s\u00a0])[\s\u00a0]++$", "")


def squeeze(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column | str) -> Column:
    t = trim_ws(c)
    return F.when(t != "", t)


def first_match(c: Column, rules: Iterable[tuple[str, Column | str]], prefix: str = "") -> Column:
    """Value of the first rule whose pattern is found; null when none is."""
    out = None
    for pattern, value in rules:
        hit = all_match(c, pattern, prefix)
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def all_match(c: Column, pattern: str | Sequence[str], prefix: str = "") -> Column:
    parts = (pattern,) if isinstance(pattern, str) else pattern
    return reduce(lambda a, b: a & b, [c.rlike(prefix + p) for p in parts])


def any_of(patterns: Iterable[str]) -> str:
    """One alternation out of several patterns."""
    return "|".join(f"(?:{p})" for p in patterns)


def quote_regex(c: Column) -> Column:
    """Escape the characters that are special in a pattern."""
    return F.regexp_replace(c, r"([.*+?^${}()|\[\]\\])", r"\\$1")


# ---------------------------------------------------------------- T1 html_to_text
def _code_unit(digits: Column) -> Column:
    n = digits.try_cast("bigint").bitwiseAND(F.lit(65535))
    return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(n), 4, "0")), "UTF-16BE"), F.lit(""))


def decode_numeric_entities(c: Column | str) -> Column:
    """``&#8217;`` style entities to characters, in one pass over the text."""
    pattern = "&#([0-9]+);"

    def decode(c: Column) -> Column:
        codes = F.regexp_extract_all(c, F.lit(pattern), 1)
        joined = F.array_join(
            F.zip_with(F.split(c, pattern, -1), codes,
                       lambda text, d: F.concat(text, F.when(d.isNull(), "").otherwise(_code_unit(d)))),
            "")
        return F.when(c.contains("&#") & c.rlike(pattern), joined).otherwise(c)

    return let(col(c), decode)


def html_to_text(c: Column | str) -> Column:
    """Readable text of an HTML fragment: entities, then tags, then white space."""
    c = col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = decode_numeric_entities(c)
    c = F.replace(F.replace(c, F.lit("&nbsp;"), F.lit(" ")), F.lit("&rsquo;"), F.lit("’"))
    for pattern, repl in (
        (r"(?i)<(script|style)[\s\S]*?</\1>", " "),
        (r"(?i)<li[^>]*>", "\n• "),
        (r"(?i)</(?:p|div|h[1-6]|ul|ol|tr)>", "\n"),
        (r"(?i)<br\s*/?>", "\n"),
        (r"<[^>]+>", " "),
        (r"[ \t]{2,}+|\t", " "),  # a single blank stays as it is
        (r"\n{3,}", "\n\n"),
    ):
        c = F.regexp_replace(c, pattern, repl)
    return trim_ws(c)


# ---------------------------------------------------------------- T2 requirements_section
def _heading_like(line: Column, words: str) -> Column:
    return let(trim_ws(line), lambda t: (
        (F.length(t) >= 1) & (F.length(t) <= V.HEADING_MAX)
        & ~t.rlike(V.BULLET_START) & ~t.rlike(r"[.,;]$")
        & t.rlike("(?i)" + word(words))))


def requirements_section(c: Column | str) -> Column:
    """``struct<section, found>``: all lines under the first requirements heading."""
    def first_heading(lines: Column, words: str) -> Column:
        return F.array_position(F.transform(lines, lambda x: _heading_like(x, words)), True).cast("int")

    def cut(after: Column) -> Column:
        stop = first_heading(after, V.STOP_HEADING_WORDS)
        body = let(stop, lambda n: F.when(n > 0, F.slice(after, 1, F.greatest(n - 1, F.lit(0))))
                   .otherwise(after))
        return trim_ws(F.array_join(body, "\n"))

    def build(lines: Column) -> Column:
        return let(first_heading(lines, V.HEADING_WORDS), lambda n: F.struct(
            F.when(n > 0, let(F.slice(lines, n + 1, F.greatest(F.size(lines), F.lit(1))), cut))
            .otherwise("").alias("section"), (n > 0).alias("found")))

    return F.when(col(c).isNotNull(), let(F.split(col(c), "\n", -1), build))


# ---------------------------------------------------------------- T3 terms_in
_EDGE = r"a-z0-9+#./"
_AFTER = r"(?![a-z0-9+#/]|\.[a-z0-9+#/])"


def vocabulary_pattern(vocab: Iterable[str]) -> str:
    """One longest-first alternation that finds the same terms as claiming spans
    globally longest first.

    An alternation alone takes the leftmost term.  Where a term can run into the
    head of a stronger one ("sound design" + "design system"), it is guarded by a
    look-ahead for the stronger one, built recursively.
    """
    terms = sorted(dict.fromkeys(t.lower() for t in vocab if t), key=lambda t: -len(t))
    rank = {t: i for i, t in enumerate(terms)}
    done: dict[str, str] = {}

    def render(term: str) -> str:
        if term not in done:
            guards = ""
            for other in terms[:rank[term]]:
                for k in range(1, min(len(term), len(other))):
                    head = term[:-k]
                    if term.endswith(other[:k]) and head[-1] not in "abcdefghijklmnopqrstuvwxyz0123456789+#./":
                        guards += f"(?!{re.escape(head)}{render(other)}{_AFTER})"
            done[term] = guards + re.escape(term)
        return done[term]

    return rf"(?<![{_EDGE}])({'|'.join(render(t) for t in terms)}){_AFTER}"


def terms_in(c: Column | str, vocab: Iterable[str]) -> Column:
    """Vocabulary terms present in the text, distinct and in alphabetical order.

    For a short list, read in one pass as a pattern; a large one is a table, see ``operators.vocabulary``.
    """
    vocab = [t for t in vocab if t]
    if not vocab:
        return F.when(col(c).isNotNull(), F.array().cast("array<string>"))
    pattern = F.lit(vocabulary_pattern(vocab))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(col(c)), pattern, 1)))


# ---------------------------------------------------------------- T4-T9 facts
def level_of(title: Column | str) -> Column:
    return first_match(col(title), [("(?i)" + word(p), name) for name, p in V.LEVEL_WORDS])


def workplace_of(title: Column | str, text: Column | str) -> Column:
    """hybrid / remote / onsite, the title before the body, strong phrases before weak."""
    title, text = col(title), col(text)

    def says(c: Column, words: str) -> Column:
        return c.rlike("(?i)" + word(words))

    return (F.when(says(title, "hybrid"), "hybrid").when(says(title, "remote"), "remote")
            .when(says(title, V.ONSITE_TITLE), "onsite")
            .when(says(text, V.STRONG_REMOTE), "remote").when(says(text, "hybrid"), "hybrid")
            .when(says(text, V.ONSITE_BODY), "onsite").when(says(text, "remote"), "remote"))


def remote_scope_of(location: Column | str, text: Column | str) -> Column:
    """Where a remote role takes people from, as a short label; null = not stated."""
    both = F.concat(F.coalesce(col(location), F.lit("")), F.lit("\n"),
                    F.coalesce(col(text), F.lit("")))
    pattern = (rf"(?i)(?<!\w)(?:remote|wfh)(?!\w)[^.\n]{{0,30}}?(?<!\w)"
               rf"((?:{V.SCOPE_NAMES})(?!\w)|u\.s\.(?=\w))"
               rf"|(?<!\w)({V.SCOPE_SHORT})[- ]?(?:only|based)(?!\w)")
    labels = F.create_map(*[F.lit(x) for kv in V.SCOPE_LABELS.items() for x in kv])

    def find(both: Column) -> Column:
        named = F.array(F.regexp_extract(both, pattern, 1), F.regexp_extract(both, pattern, 2))
        return F.lower(F.try_element_at(F.filter(named, lambda x: x != ""), F.lit(1)))

    # Spark spells a lookup in a constant map out, one comparison per key: the name must not be searched for in each.
    return let(let(both, find), lambda raw: F.when(raw.isNotNull(), F.coalesce(labels[raw], F.upper(raw))))


_YEARS_BEHIND = "|".join(rf"{w}[\s\S]{{0,{30 - len(w)}}}" for w in V.YEARS_WORDS)
_YEARS_ASK = r"(?<!\d)(\d{1,2})(?!\d)\s*(?:\+|-|–|\s+to\s+)?\s*(?:\d{1,2})?\s*\+?\s*years?(?!\w)"
YEARS_PATTERN = (rf"(?i)(?=\d)(?={_YEARS_ASK.replace('(' + chr(92) + 'd{1,2})', chr(92) + 'd{1,2}')})(?:(?<={_YEARS_BEHIND}){_YEARS_ASK}[^.\n]{{0,40}}"
                 rf"|{_YEARS_ASK}([^.\n]{{0,40}}))")
YEARS_AHEAD = r"(?i)experience|exp(?!\w)|working|background|industry"


def required_years(c: Column | str) -> Column:
    """Low end of the first years-of-experience range next to an experience word."""
    p = F.lit(YEARS_PATTERN)

    def find(text: Column) -> Column:
        hits = F.arrays_zip(F.regexp_extract_all(text, p, 1).alias("near"),
                            F.regexp_extract_all(text, p, 2).alias("far"),
                            F.regexp_extract_all(text, p, 3).alias("trail"))
        years = F.transform(hits, lambda h: F.when(h["near"] != "", h["near"].cast("int"))
                            .when(h["trail"].rlike(YEARS_AHEAD), h["far"].cast("int")))
        first = F.try_element_at(F.filter(years, lambda y: y <= 30), F.lit(1))
        return F.when(text.rlike(r"(?i)\d\s*\+?\s*years?"), first)

    return let(col(c), find)


def country_of(location: Column | str, gazetteer: Iterable[tuple[str, str]] = V.GAZETTEER) -> Column:
    """Country of a free-text location by the ordered gazetteer; null when unrecognised."""
    low = F.lower(col(location))
    return first_match(low, [(word(p) + (r"|(?<!\w)u\.s\.(?=\w)" if name == "United States" else ""),
                              name) for p, name in gazetteer])


def summary_of(c: Column | str, chars: int = V.SUMMARY_CHARS) -> Column:
    return F.struct(F.substring(col(c), 1, chars).alias("summary"),
                    F.length(col(c)).alias("chars"))


# ---------------------------------------------------------------- T11-T15 labels
def normalise_label(c: Column | str) -> Column:
    """The key under which the same question of different employers is one question."""
    c = F.lower(col(c))
    for pattern, repl in (
        (r"\(.*?\)", " "), (r"\[.*?\]", " "), ("[‘’]", "'"), ("[“”]", '"'),
        (r"https?://\S+", " "), (r"&[a-z]+;", " "), (r"<[^>]+>", " "),
        (r"[^a-z0-9\s'/-]", " "), (r"\b(please|kindly)\b", " "),
    ):
        c = F.regexp_replace(c, pattern, repl)
    return squeeze(c)


def classify_question(label_key: Column | str, field_kinds: Column | str,
                      is_demographic: Column | None = None) -> Column:
    """demographic / file / profile / generated / bank."""
    key, kinds = col(label_key), col(field_kinds)
    demographic = key.rlike(any_of(V.DEMOGRAPHIC_PATTERNS))
    if is_demographic is not None:
        demographic = is_demographic | demographic
    return (F.when(demographic, "demographic")
            .when(F.array_contains(kinds, "file") & ~key.contains("cover letter"), "file")
            .when(key.rlike(any_of(V.PROFILE_CLASS_PATTERNS)), "profile")
            .when(key.rlike(any_of(V.GENERATED_PATTERNS)), "generated")
            .when(F.array_contains(kinds, "long_text"), "generated")
            .otherwise("bank"))


def field_kind(vendor_type: Column | str) -> Column:
    kinds = F.create_map(*[F.lit(x) for kv in V.FIELD_KINDS.items() for x in kv])
    return F.coalesce(kinds[F.coalesce(col(vendor_type), F.lit(""))], F.lit("unknown"))


def human_only(label_key: Column | str) -> Column:
    return col(label_key).rlike(any_of(V.HEALTH_PATTERNS + V.CONSENT_PATTERNS))


def forbids_generated(label_key: Column | str) -> Column:
    return col(label_key).rlike(any_of(V.NO_AI_PATTERNS))


# ---------------------------------------------------------------- T16-T17 profile fields
def profile_field_for(label_key: Column | str,
                      patterns: Iterable[tuple] = V.PROFILE_FIELD_PATTERNS) -> Column:
    """Which profile field a label key asks for; null when none."""
    return first_match(col(label_key), patterns)


PROFILE_VALUE_FIELDS = tuple(dict.fromkeys(f for _, f in V.PROFILE_FIELD_PATTERNS))


def profile_values(available: Iterable[str], prefix: str = "") -> Column:
    """Map of profile field to its value, built from the columns a table has."""
    have = set(available)
    pairs: list[Column] = []
    for f in PROFILE_VALUE_FIELDS:
        if f == "full_name":
            value = F.concat_ws(" ", *[F.col(prefix + n) for n in ("first_name", "last_name")
                                       if n in have])
        elif f in have:
            value = F.col(prefix + f)
        else:
            continue
        pairs += [F.lit(f), value]
    return F.create_map(*pairs)


def resolve_profile_value(label_key: Column | str, values: Column | str) -> Column:
    """Value for the field a label key asks for; a matched blank field gives null."""
    return blank_to_null(F.try_element_at(col(values), profile_field_for(label_key)))


# ---------------------------------------------------------------- T18-T19 options
def canon_option(c: Column | str) -> Column:
    c = F.lower(col(c))
    for pattern in (r"\(.*?\)", r"[^a-z0-9\s+]", rf"\b({V.OPTION_FILLERS})\b"):
        c = F.regexp_replace(c, pattern, " ")
    return squeeze(c)


def synonym_class(canon: Column | str, groups: Sequence[Sequence[str]] = V.OPTION_SYNONYMS) -> Column:
    """Index of the equivalence class of a canonical option; null when none."""
    table = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for name in g for x in (name, i)])
    return F.try_element_at(table, col(canon))


# ---------------------------------------------------------------- T20-T21 urls, companies
def posting_ref(url: Column | str, hosts: Sequence[str] = V.POSTING_HOSTS) -> Column:
    """``struct<board, external_id>`` of a posting page address; null when unreadable."""
    url = col(url)
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    seg = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/", -1),
                   lambda s: s != "")

    def query(name: str) -> Column:
        return F.nullif(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)), F.lit(""))

    s1, s2, s3 = (F.try_element_at(seg, F.lit(i)) for i in (1, 2, 3))
    jid = query("gh_jid")
    is_job_path = (F.array_position(seg, "jobs") == 2) & s3.isNotNull()
    board = F.when(s1 == "embed", query("for")).otherwise(s1)
    ident = (F.when(s1 == "embed", F.coalesce(query("token"), jid))
             .when(is_job_path, F.when(s3.rlike(r"^\d+$"), s3).otherwise(jid))
             .otherwise(jid))
    return F.when(host.isin(*hosts) & board.isNotNull() & ident.isNotNull(),
                  F.struct(board.alias("board"), ident.alias("external_id")))


def company_key(c: Column | str) -> Column:
    """A company name as a person types it."""
    low = squeeze(F.regexp_replace(F.lower(col(c)), "[’']", "'"))
    cut = F.regexp_replace(low, V.COMPANY_SUFFIX, "")
    return trim_ws(F.regexp_replace(cut, "[^a-z0-9 ]", ""))


# ---------------------------------------------------------------- T22-T25 claims in a line
_NUMBER = r"(?i)(\d[\d,]*(?:\.\d+)?)\s*(%|(?:x|k|m|bn)(?!\w))?"


def numbers_in(c: Column | str) -> Column:
    """Numbers stated in a line, number words as digits, with a unit where written."""
    c = col(c)
    low = F.lower(c)
    words = F.filter(
        F.array(*[F.when(low.rlike(rf"(^|[^a-z]){w}($|[^a-z])"), F.lit(str(i)))
                  for i, w in enumerate(V.NUMBER_WORDS)]), lambda x: x.isNotNull())
    p = F.lit(_NUMBER)
    digits = F.zip_with(
        F.regexp_extract_all(c, p, 1), F.regexp_extract_all(c, p, 2),
        lambda v, u: F.concat(F.regexp_replace(F.replace(v, F.lit(","), F.lit("")), r"\.0+$", ""),
                              F.lower(u)))
    return F.array_distinct(F.concat(words, digits))


def credit_groups_in(c: Column | str) -> Column:
    """Which kinds of credit (lead, own, manage, …) a line claims."""
    low = F.lower(col(c))
    return F.filter(
        F.array(*[F.when(low.rlike(rf"(^|[^a-z])(?:{words})($|[^a-z])"), F.lit(group))
                  for group, words in V.CREDIT_GROUPS.items()]), lambda x: x.isNotNull())


def proper_nouns_in(c: Column | str) -> Column:
    """Capitalised words that do not start a sentence."""
    def find(raw: Column) -> Column:
        before = F.concat(F.array(F.lit(".")), raw)
        kept = F.zip_with(raw, before, lambda w, b: F.when(
            ~b.rlike(r"[.!?]$"), F.regexp_replace(F.regexp_replace(w, r"^\W+", ""), r"[^\w.+#/-]+$", "")))
        return F.array_distinct(F.filter(kept, lambda w: w.rlike(r"^[A-Z][A-Za-z0-9.+#/-]+$")))

    return let(F.filter(F.split(col(c), r"\s+", -1), lambda w: w != ""), find)


def title_words(c: Column | str, stop: Sequence[str] = V.TITLE_STOP_WORDS) -> Column:
    """Meaningful words of a job title, without seniority and generic nouns."""
    words = F.split(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9+#\s]", " "), r"\s+", -1)
    return F.array_sort(F.array_except(F.filter(words, lambda w: F.length(w) > 2),
                                       F.array(*[F.lit(s) for s in stop])))


# ---------------------------------------------------------------- T26-T30
def _word_body(word: Column) -> Column:
    return F.concat(quote_regex(word), F.lit("(s|es|ing)?"))


def title_matches(title: Column | str, words: Column | str) -> Column:
    """Every word stands in the title as a whole word, plain or with s / es / ing.

    The substring test goes first: it is cheap and spares most of the patterns.
    """
    low = F.lower(col(title))
    return F.forall(col(words), lambda w: F.contains(low, w) & F.rlike(
        low, F.concat(F.lit("(^|[^a-z0-9])"), _word_body(w), F.lit("($|[^a-z0-9])"))))


def title_has_phrase(title: Column | str, words: Column | str) -> Column:
    """The words stand in the title side by side in the order given."""
    low, words = F.lower(col(title)), col(words)
    body = F.array_join(F.transform(words, _word_body), r"[\s/-]+")
    phrase = F.rlike(low, F.concat(F.lit("(^|[^a-z0-9])"), body, F.lit("($|[^a-z0-9])")))
    return F.when(F.size(words) < 2, title_matches(title, words)).otherwise(
        F.forall(words, lambda w: F.contains(low, w)) & phrase)


def names_employer(label: Column | str, company: Column | str) -> Column:
    """The label holds the first word of the company that has three letters or more."""
    first = F.try_element_at(F.filter(F.split(F.lower(col(company)), "[^a-z0-9]+", -1),
                                      lambda w: F.length(w) >= 3), F.lit(1))
    hit = F.rlike(F.lower(col(label)), F.concat(F.lit(r"(?<!\w)"), first, F.lit(r"(?!\w)")))
    return F.coalesce(hit, F.lit(False))


def employer_name(token: Column | str) -> Column:
    """A board token as a name: separators to spaces, each word's first letter raised."""
    token = col(token)
    clean = trim_ws(F.regexp_replace(token, "[-_]+", " "))
    name = F.array_join(F.transform(
        F.split(clean, " ", -1),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")
    return F.when(clean == "", token).otherwise(name)


def label_from_key(key: Column | str) -> Column:
    key = col(key)
    clean = trim_ws(F.regexp_replace(key, "[-_]+", " "))
    return F.when(clean == "", key).otherwise(
        F.concat(F.upper(F.substring(clean, 1, 1)), F.substr(clean, F.lit(2))))


def days_old(ts: Column | str, now: Column) -> Column:
    """Whole days between two instants, rounded down; null in, null out."""
    gap = F.unix_millis(now.cast("timestamp")) - F.unix_millis(col(ts).cast("timestamp"))
    return F.floor(gap / F.lit(86_400_000))


def canonical_json(c: Column | str) -> Column:
    """Text of a struct in the key order of its schema, with nulls kept.

    ``schemas.FILTERS`` declares its fields alphabetically, so equal filters have
    equal text whatever the key order of the JSON they were read from.
    """
    return F.to_json(col(c), {"ignoreNullFields": "false"})
