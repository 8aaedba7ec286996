"""Capture filters and HTML rendering of event rows; valid for batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import text as tx

# fixed values: login failures are reported elsewhere; statement events and the
# duration from which they are slow
LOGIN_FAILED = 18456
SLOW_US = 250_000
TIMED_EVENTS = ("module_end", "rpc_completed", "sp_statement_completed", "sql_statement_completed")


def error_event_filter(events: DataFrame, *, min_severity: int = 10, skip_number: int = LOGIN_FAILED) -> DataFrame:
    """Errors above a severity, login failures left out."""
    return events.where((F.col("severity") > min_severity) & (F.col("error_number") != skip_number))


def session_error_filter(events: DataFrame, *, session_id: int, min_severity: int = 10) -> DataFrame:
    """Errors with a message of one session."""
    return events.where(
        (F.col("message") != "") & (F.col("severity") > min_severity) & (F.col("session_id") == session_id)
    )


def slow_statement_filter(events: DataFrame, *, min_us: int = SLOW_US) -> DataFrame:
    """Slow statements, every cursor execution, and errors with a message."""
    slow = F.col("name").isin(*TIMED_EVENTS) & (F.col("duration_us") >= min_us)
    error = (F.col("name") == "error_reported") & (F.col("message") != "") & (F.col("severity") > 10)
    return events.where(slow | error | (F.col("name") == "cursor_execute"))


def error_html_rows(errors: DataFrame, cells: list[str], *, keep: list[str]) -> DataFrame:
    """One HTML table row per error; text is escaped, line breaks become <br/>."""
    def cell(name: str) -> Column:
        return F.regexp_replace(tx.html_escape(F.col(name).cast("string")), r"\r?\n", "<br/>")

    return errors.select(*keep, tx.html_row([cell(c) for c in cells]).alias("html"))


_ROOT = r"(?s)<(?:[\w.-]+:)?EVENT_INSTANCE(?:\s[^<>]*)?>(.*)</(?:[\w.-]+:)?EVENT_INSTANCE\s*>"
# an element without markup inside; its name and text
_LEAF = r"""<(?:[\w.-]+:)?([\w.-]+)(?:\s(?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)?(?<!/)>([^<]*+)</[^<>]*+>"""
# name and text of an element while a document is worked on: characters no XML document holds
_NAME, _TEXT, _END = "\x01", "\x02", "\x03"
_TAG = r"""<(?:[^<>"']++|"[^"]*+"|'[^']*+')*+>"""


def _plain_markup(body: Column) -> Column:
    """The document without comments, and with CDATA sections as escaped text."""
    pieces = F.split(body, r"<!\[CDATA\[")
    section = lambda p: F.concat(tx.html_escape(F.substring_index(p, "]]>", 1)), F.substr(p, F.length(F.substring_index(p, "]]>", 1)) + 4))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(section(p))), "")
    text = F.when(F.contains(body, F.lit("<![CDATA[")), joined).otherwise(body)
    return F.when(F.contains(text, F.lit("<!--")), F.regexp_replace(text, r"(?s)<!--.*?-->", "")).otherwise(text)


def event_to_html(body: Column) -> Column:
    """Name and value table of all children of an event, in document order.

    ``body`` is the text of a readable event document.  The value of a child is its text
    with that of everything below it, also below children of its own name; the references
    for <, > and & stay as they are, so the cells are escaped.  Comments give nothing, CDATA
    sections are text.
    """
    # elements without markup inside are marked in one pass, so that the walk sees only the tags of the others
    inner = F.regexp_replace(F.regexp_extract(_plain_markup(body), _ROOT, 1), _LEAF, f"{_NAME}$1{_TEXT}$2{_END}")
    def row(name: Column, value: Column) -> Column:
        text = F.when(F.contains(value, F.lit(_NAME)), F.regexp_replace(value, f"{_NAME}[^{_TEXT}]*+{_TEXT}|{_END}", "")).otherwise(value)
        return F.concat(F.lit(_NAME), name, F.lit(_TEXT), text, F.lit(_END))

    def walk(state: Column, step: Column) -> Column:
        tag, depth = step["tag"], state["depth"]
        other = F.startswith(tag, F.lit("<?")) | F.startswith(tag, F.lit("<!"))
        ends = F.startswith(tag, F.lit("</"))
        empty = F.endswith(tag, F.lit("/>"))
        name = F.regexp_extract(tag, r"^<(?:[\w.-]+:)?([\w.-]+)", 1)
        top, opens = depth == 0, ~other & ~ends & ~empty
        # behind a tag that leaves no child open, elements of the text are children
        closed = (top & ~opens) | (ends & (depth == 1))
        return F.struct(
            F.when(other | empty, depth).when(ends, depth - 1).otherwise(depth + 1).alias("depth"),
            F.when(top & opens, name).otherwise(state["name"]).alias("name"),
            F.when(top, step["text"]).otherwise(F.concat(state["text"], step["text"])).alias("text"),
            F.when(ends & (depth == 1), F.concat(state["rows"], row(state["name"], state["text"]), step["text"]))
            .when(empty & top, F.concat(state["rows"], row(name, F.lit("")), step["text"]))
            .when(closed, F.concat(state["rows"], step["text"])).otherwise(state["rows"]).alias("rows"),
        )

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit("").alias("text"), F.lit("").alias("rows"))

    def table(x: Column) -> Column:
        # the tags, each with the text behind it; a first step holds the text before all tags
        tags = F.concat(F.array(F.lit("<?>")), F.regexp_extract_all(x, F.lit(_TAG), F.lit(0)))
        steps = F.zip_with(tags, F.split(x, _TAG), lambda t, behind: F.struct(t.alias("tag"), behind.alias("text")))
        rows = F.regexp_extract(F.aggregate(steps, start, walk)["rows"], f"(?s).*{_END}", 0)
        rows = F.regexp_replace(rows, f"[^{_NAME}]*+{_NAME}([^{_TEXT}]*+){_TEXT}([^{_END}]*+){_END}", "<tr><td>$1</td><td>$2</td></tr>")
        rows = F.replace(F.replace(rows, F.lit("&quot;"), F.lit('"')), F.lit("&apos;"), F.lit("'"))
        return F.replace(F.concat(F.lit('<table border="1">'), rows, F.lit("</table><br/>")), F.lit(tx.CRLF), F.lit("<br/>"))

    # a function of one element: what is used twice inside a function is worked out again each time, its argument is not
    return F.get(F.transform(F.array(inner), table), F.lit(0))
