"""Answers as text: an aligned table of few rows, and what the caveats mean."""

from __future__ import annotations

from lattica.plans.answers import MOST_ROWS, Result

WIDEST = 60
MEANING = {
    "truncated": "there are more rows than shown",
    "relaxed": "letters were cut off the words, or not all words had to occur",
    "lexical-only": "fields are found by their words, not by what they mean",
    "untyped-blind-spot": "values of assets without a type are matched by name alone",
    "pre-inheritance": "what is counted is what documents say themselves, without what they inherit",
    "container-no-observations": "objects and lists have no values of their own",
    "cardinality-elided": "some field has too many values to list",
    "ambiguous-identifier": "assets of several types have this name",
    "join-incomplete": "not every observed field is declared, nor every declared one observed",
    "names-not-values": "search looks at names and texts, not at values",
    "identifier-only": "only identifiers hold this text",
    "crosses-into": "the field goes on in another scope",
    "argument-ignored": "a type was given that plays no part in this answer",
    "bench-undeclared": "nothing declares this station",
    "pointer-repaired": "the pointer was not written as pointers are",
    "third-party": "some of this comes from other packs than the game's own",
    "working-pack": "some of this comes from the pack being worked on",
    "shadowed": "several packs define this; one of them holds",
    "contested-packs": "several packs of equal rank define this",
    "wrong-type": "the name exists, but not with this type",
    "miss": "nothing was found",
}


def clip(value: object, width: int = WIDEST) -> str:
    """On one line and no longer than width; null is a dash, a flag yes or no."""
    if value is None:
        return "-"
    if isinstance(value, bool):
        return "yes" if value else "no"
    text = " ".join((f"{value:,}" if isinstance(value, int) else ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)).split())
    return text if len(text) <= width else text[: width - 1] + "…"


def render(result: Result, limit: int = MOST_ROWS) -> str:
    """A result's first rows, at most MOST_ROWS of them, as an aligned table with numbers to the right, and its caveats below."""
    limit = min(limit, MOST_ROWS)
    rows = result.rows.limit(limit + 1).collect()
    names = result.rows.columns
    cells = [[clip(v) for v in r] for r in rows[:limit]]
    right = [any(isinstance(r[i], (int, float)) and not isinstance(r[i], bool) for r in rows[:limit]) for i in range(len(names))]
    widths = [max(len(n), *(len(c[i]) for c in cells), 0) for i, n in enumerate(names)]
    line = lambda c: "  ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(c, widths, right)).rstrip()
    out = [line(names), "  ".join("-" * w for w in widths), *map(line, cells)] if cells else ["(nothing)"]
    caveats = sorted(set(result.caveats) | ({"truncated"} if len(rows) > limit else set()))
    return "\n".join([*out, *(f"! {c}: {MEANING.get(c, c)}" for c in caveats)]) + "\n"
