"""Column helpers for names, paths, money text and case-insensitive matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRLF = "\r\n"
TAB = "\t"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quotename(x: Column | str) -> Column:
    """Bracket a name, doubling closing brackets."""
    return F.concat(F.lit("["), F.replace(_c(x), F.lit("]"), F.lit("]]")), F.lit("]"))


def basename(path: Column | str) -> Column:
    """Last segment of a backslash path."""
    return F.substring_index(_c(path), "\\", -1)


def with_backslash(path: str | None) -> str:
    """Directory argument, empty or ending in one backslash."""
    path = path or ""
    return path if path == "" or path.endswith("\\") else path + "\\"


def parsename(x: Column | str, part: int) -> Column:
    """Part of a dotted name counted from the right; NULL when there are fewer."""
    return F.try_element_at(F.split(_c(x), r"\."), F.lit(-part))


def money_text(amount: Column) -> Column:
    """Thousands separators and two decimals."""
    return F.format_number(F.round(amount.cast("decimal(19,4)"), 2), 2)


def text_length(x: Column | str) -> Column:
    """Length that ignores trailing blanks."""
    return F.length(F.rtrim(_c(x)))


def ci_equals(x: Column, text: str) -> Column:
    return F.lower(x) == F.lit(text.lower())


def ci_isin(x: Column, names: list[str] | tuple[str, ...]) -> Column:
    return F.lower(x).isin([n.lower() for n in names])


def ci_like_any(x: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Case-insensitive LIKE against any of a few patterns."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | x.ilike(pattern)
    return hit


def listed_in_csv(login: Column, allowed: str, *, exact: bool = False) -> Column:
    """Is the login on a comma-separated list, ignoring case?

    The default is containment of the text, so a login that is part of a longer
    listed one passes; ``exact`` compares whole entries.  An empty login never
    passes, a NULL login gives NULL.
    """
    if exact:
        entries = [p.strip().lower() for p in allowed.split(",") if p.strip()]
        return F.lower(login).isin(entries) if entries else F.lit(False)
    return (F.length(login) > 0) & F.contains(F.lit(allowed.lower()), F.lower(login))


def html_escape(x: Column) -> Column:
    out = F.replace(x, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def html_row(cells: list[Column], *, null_text: str = "") -> Column:
    """One table row; NULL cells show ``null_text``."""
    parts: list[Column] = [F.lit("<tr>")]
    for cell in cells:
        parts += [F.lit("<td>"), F.coalesce(cell.cast("string"), F.lit(null_text)), F.lit("</td>")]
    return F.concat(*parts, F.lit("</tr>"))


def html_header(names: list[str]) -> str:
    return "<tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
