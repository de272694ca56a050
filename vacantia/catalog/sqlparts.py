"""Pieces of check SQL (DuckDB, RE2: no look-around, ASCII word edges)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from vacantia import fixed_values as V


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sub(expr: str, pattern: str, repl: str, flags: str = "g") -> str:
    r = "chr(10)" if repl == "\n" else repl if repl.startswith("chr(") else lit(repl)
    return f"regexp_replace({expr}, {lit(pattern)}, {r}, '{flags}')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def any_of(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def trim(expr: str) -> str:
    return sub(expr, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", "")


def squeeze(expr: str) -> str:
    return trim(sub(expr, r"\s+", " "))


def html(expr: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#8217;", "’"),
                 ("&nbsp;", " "), ("&rsquo;", "’")):
        expr = f"replace({expr}, {lit(a)}, {lit(b)})"
    for p, r in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "),
                 (r"(?i)<li[^>]*>", "chr(10) || '• '"), (r"(?i)</(?:p|div|h[1-6]|ul|ol|tr)>", "\n"),
                 (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", " "), (r"[ \t]+", " "),
                 (r"\n{3,}", "chr(10) || chr(10)")):
        expr = sub(expr, p, r)
    return trim(expr)


def label_key(expr: str) -> str:
    expr = f"lower({expr})"
    for p, r in ((r"\(.*?\)", " "), (r"\[.*?\]", " "), ("[‘’]", "'"), ("[“”]", '"'), (r"https?://\S+", " "),
                 (r"&[a-z]+;", " "), (r"<[^>]+>", " "), (r"[^a-z0-9\s'/-]", " "),
                 (r"\b(please|kindly)\b", " ")):
        expr = sub(expr, p, r)
    return squeeze(expr)


def term_masks(expr: str, vocab: Sequence[str]) -> list[tuple[str, str]]:
    """(term, test) pairs, longest term first; each test reads the text with longer terms blanked."""
    out, text = [], f"lower({expr})"
    for t in sorted(vocab, key=lambda x: -len(x)):
        esc = "".join("\\" + c if c in r".*+?^${}()|[]\\" else c for c in t)
        pat = rf"(^|[^a-z0-9+#./]){esc}($|[^a-z0-9+#/.]|\.($|[^a-z0-9+#/]))"
        out.append((t, has(text, pat)))
        text = sub(sub(text, pat, r"\1~\2"), pat, r"\1~\2")
    return out


def terms(expr: str, vocab: Sequence[str]) -> str:
    """Comma list of the terms present, in alphabetical order."""
    tests = dict(term_masks(expr, vocab))
    parts = ", ".join(f"CASE WHEN {tests[t]} THEN {lit(t)} END" for t in sorted(vocab))
    return f"concat_ws(',', {parts})"


def classify(key: str, kinds: str) -> str:
    """``kinds`` is a text that holds the field kinds."""
    return (f"CASE WHEN {has(key, any_of(V.DEMOGRAPHIC_PATTERNS))} THEN 'demographic' "
            f"WHEN contains({kinds}, 'file') AND NOT contains({key}, 'cover letter') THEN 'file' "
            f"WHEN {has(key, any_of(V.PROFILE_CLASS_PATTERNS))} THEN 'profile' "
            f"WHEN {has(key, any_of(V.GENERATED_PATTERNS))} THEN 'generated' "
            f"WHEN contains({kinds}, 'long_text') THEN 'generated' ELSE 'bank' END")


def profile_field(key: str) -> str:
    arms = []
    for p, f in V.PROFILE_FIELD_PATTERNS:
        test = " AND ".join(has(key, x) for x in ((p,) if isinstance(p, str) else p))
        arms.append(f"WHEN {test} THEN {lit(f)}")
    return f"CASE {' '.join(arms)} END"


def human_only(key: str) -> str:
    return has(key, any_of(V.HEALTH_PATTERNS + V.CONSENT_PATTERNS))


def route(key: str, kind: str) -> str:
    return (f"CASE WHEN {human_only(key)} OR {kind} = 'demographic' THEN 'yours' WHEN {kind} = 'file' THEN 'skip' "
            f"WHEN {kind} = 'generated' THEN 'perPosting' WHEN {profile_field(key)} IS NOT NULL THEN 'profile' "
            f"ELSE 'bank' END")


def canon(expr: str) -> str:
    expr = f"lower({expr})"
    for p in (r"\(.*?\)", r"[^a-z0-9\s+]", rf"\b({V.OPTION_FILLERS})\b"):
        expr = sub(expr, p, " ")
    return squeeze(expr)


def synonym(expr: str) -> str:
    arms = " ".join(f"WHEN {expr} IN ({', '.join(lit(x) for x in g)}) THEN {i}"
                    for i, g in enumerate(V.OPTION_SYNONYMS))
    return f"CASE {arms} END"


def title_words(expr: str) -> str:
    stop = ", ".join(lit(w) for w in V.TITLE_STOP_WORDS)
    return (f"list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({expr}), "
            f"'[^a-z0-9+#\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({stop}))))")


def word_case(rules: Iterable[tuple[str, str]], expr: str) -> str:
    return "CASE " + " ".join(f"WHEN {has(expr, '(?i)' + chr(92) + 'b(?:' + p + ')' + chr(92) + 'b')} "
                              f"THEN {lit(v)}" for v, p in rules) + " END"
