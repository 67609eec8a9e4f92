"""DuckDB expressions for the oracles, written from the semantics of the text kernel."""

from __future__ import annotations

from .. import config

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def values(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'))"


def retrieval(c: str) -> str:
    return collapse(f"translate(lower(coalesce({c}, '')), '–—', '--')")


def rag(c: str) -> str:
    return collapse(f"regexp_replace(translate(lower(coalesce({c}, '')), '–—-', '   '), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s\\p{{Z}}.+%°®/]', ' ', 'g')")


def plot(c: str) -> str:
    return collapse(f"regexp_replace(replace(replace(translate(lower(coalesce({c}, '')), '–—', '--'), '≥', '>='), '≤', '<='), '[^a-z0-9.%+\\-=\\s\\p{{Z}}]', ' ', 'g')")


def expected(c: str) -> str:
    return collapse(f"lower(coalesce({c}, ''))")


def display(c: str) -> str:
    return f"trim({collapse(f'coalesce({c}, {chr(39)}{chr(39)})')}, ' |;,')"


def tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all({retrieval(c)}, '[a-z0-9]+(?:[-./][a-z0-9]+)*'), lambda t: length(t) > 1 AND NOT list_contains({values(config.STOPWORDS)}, t))"


def words(c: str) -> str:
    """Runs of ASCII letters and digits that stand alone among all word characters."""
    return f"list_filter(string_split_regex({rag(c)}, '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda t: regexp_full_match(t, '[a-z0-9]+'))"


def focus(c: str) -> str:
    return f"list_filter({words(c)}, lambda t: length(t) >= 4 AND NOT list_contains({values(config.FOCUS_IGNORED)}, t))"


def any_of(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def ordered_distinct(c: str) -> str:
    """First occurrences in order."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def doc_type(c: str) -> str:
    """The type rules over a collapsed lower-case text."""
    cases = []
    for label, rule in config.DOC_TYPES:
        test = any_of(c, rule["any"])
        if "or_all" in rule:
            test += " OR (" + " AND ".join(f"contains({c}, '{t}')" for t in rule["or_all"]) + ")"
        if "count" in rule:
            n, terms = rule["count"]
            test += " OR " + " + ".join(f"contains({c}, '{t}')::INT" for t in terms) + f" >= {n}"
        if "with" in rule:
            head, terms = rule["with"]
            test += f" OR (contains({c}, '{head}') AND {any_of(c, terms)})"
        if "word" in rule:
            test += f" OR regexp_matches({c}, '\\b{rule['word']}\\b')"
        cases.append(f"WHEN {test} THEN '{label}'")
    return f"CASE {' '.join(cases)} ELSE 'Unknown' END"
