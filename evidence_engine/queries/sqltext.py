"""Fragments of DuckDB SQL that several oracles share."""

from __future__ import annotations

from evidence_engine.fixtures import ENTITIES, LEXICON, NOW
from evidence_engine.functions.text import ACCENTED, PLAIN

STAMP = f"TIMESTAMP '{NOW}'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(quoted(x) for x in items) + "]"


def normalized(x: str) -> str:
    x = f"lower(translate(coalesce({x}, ''), {quoted(ACCENTED)}, {quoted(PLAIN)}))"
    for pattern, by in ((r"https?://\S+", " "), ("&amp;", " and "), (r"[^a-z0-9₹$%+.\-]+", " "), (r"\s+", " ")):
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return f"trim({x})"


def tokens(x: str) -> str:
    return (
        f"list_sort(list_distinct(list_transform(list_filter(string_split({normalized(x)}, ' '), lambda w: length(w) > 2 AND NOT list_contains({listed(LEXICON.stop_words)}, w)), "
        "lambda w: CASE WHEN w = 'thanea.' THEN 'thanea' ELSE w END)))"
    )


def terms(x: str, weights: dict) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({x}, {quoted(t)}) THEN {w} ELSE 0 END" for t, w in weights.items()) + ")"


def tone(x: str) -> str:
    return f"CAST(greatest(-100, least(100, {terms(x, {**dict.fromkeys(LEXICON.positive, 7)})} + {terms(x, dict.fromkeys(LEXICON.negative, -8))})) AS INT)"


def rounded(x: str) -> str:
    return f"CAST(floor({x} + 0.5) AS INT)"


def clamped(x: str, low: int = 0, high: int = 100) -> str:
    return f"greatest({low}, least({high}, {x}))"


def category(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {quoted(p)}) THEN {quoted(n)}" for n, p in LEXICON.categories) + " ELSE 'Corporate' END"


def fnv36(x: str) -> str:
    units = f"list_transform(list_filter(string_split({x}, ''), lambda c: c <> ''), lambda c: unicode(c)::BIGINT)"
    return f"lower(to_base(list_reduce(list_prepend(2166136261::BIGINT, {units}), lambda h, c: ((xor(h, c) * 16777619) & 4294967295)), 36))"


def cleaned(x: str) -> str:
    for pattern, by in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"<[^>]+>", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), (r"\s+", " ")):
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(by)}, 'g')"
    return f"trim({x})"


def filled(template: str, who: str) -> str:
    before, gap, after = template.partition("{}")
    return f"({quoted(before)} || {who} || {quoted(after)})" if gap else quoted(template)


def jaccard(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END)"


def any_of(x: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in patterns) + ")"


def matches(name: str, source: str, text: str) -> str:
    """A table (ord, entity_id, type, tier, matched_alias) of the entities in text, of rows of source."""
    phrase = LEXICON.context_phrase
    parents = {e[0]: e[1] for e in ENTITIES}
    rows = []
    for e_id, alias, kind, tier, parent, ambiguous in ENTITIES:
        context = [t for t in ([parents[parent]] if parent and len(parents[parent]) > 3 else []) + [phrase]]
        needs = ambiguous or len(alias) <= 4
        found = f"regexp_matches(body, '(^|[^a-z0-9]){alias}([^a-z0-9]|$)')"
        if needs:
            found += " AND (" + " OR ".join(f"contains(body, {quoted(c)})" for c in context) + ")"
        rows.append(f"SELECT ord, body, {quoted(e_id)} AS entity_id, {quoted(kind)} AS type, {tier} AS tier, {quoted(alias)} AS matched_alias FROM {name}_b WHERE {found}")
    union = "\nUNION ALL ".join(rows)
    return f"""{name}_b AS (SELECT ord, ' ' || {normalized(text)} || ' ' AS body FROM {source}),
{name}_h AS ({union}),
{name} AS (SELECT ord, entity_id, type, tier, matched_alias FROM {name}_h h WHERE type <> 'stakeholder' OR contains(body, ' {phrase} ')
   OR EXISTS (SELECT 1 FROM {name}_h g WHERE g.ord = h.ord AND g.type <> 'stakeholder'))"""
