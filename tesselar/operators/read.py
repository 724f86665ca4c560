"""The read surface: searches, filters, sorts and pages as parameterised DataFrame functions."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselar.functions import keys as K

PAGE, MOST = 50, 200


def page_size(asked: int | None, default: int = PAGE, most: int = MOST) -> int:
    return max(1, min(asked or default, most))


def cursor(*values: str) -> str:
    return base64.urlsafe_b64encode(json.dumps(values).encode()).decode()


def read_cursor(text: str) -> list[str]:
    return json.loads(base64.urlsafe_b64decode(text))


def search(rows: DataFrame, text: str | None, columns: list[str], phone: str | None = None) -> DataFrame:
    """Any column contains the text, in any case; of eight or more digits also the phone their last eight."""
    if not text:
        return rows
    wanted = F.lit(False)
    for c in columns:
        wanted = wanted | F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower()))
    number = "".join(ch for ch in text if ch.isdigit())
    if phone and len(number) >= 8:
        wanted = wanted | F.contains(K.digits(F.col(phone)), F.lit(number[-8:]))
    return rows.where(wanted)


def where_given(rows: DataFrame, **filters) -> DataFrame:
    """Conjunction of the filters that are given (P2, P4, P7, P8): name for equality, name__ge, name__has."""
    for name, value in filters.items():
        if value is None:
            continue
        column, _, op = name.partition("__")
        rows = rows.where({"": lambda: F.col(column) == value, "ge": lambda: F.col(column) >= value, "has": lambda: F.array_contains(column, value)}[op]())
    return rows


def sorted_page(rows: DataFrame, sort: str, allowed: list[str], descending: bool, tie: str, page: int = 1, size: int = PAGE) -> DataFrame:
    """A page by a listed column, nulls last both ways, ties by id (L1, L2, L3)."""
    if sort not in allowed:
        raise ValueError(f"sort must be one of {allowed}")
    c = F.col(sort)
    return rows.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie).asc()).offset((page - 1) * size).limit(size)


def page_of(rows: DataFrame, sort: str, allowed: list[str], descending: bool, tie: str, page: int | None = None, size: int | None = None) -> DataFrame:
    """A page as it is asked for: pages from 1, of 5 to 100 rows (L2)."""
    return sorted_page(rows, sort, allowed, descending, tie, max(1, page or 1), max(5, min(size or PAGE, 100)))


def message_page(rows: DataFrame, at: str, ties: list[str], descending: bool = True, limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Messages by time, either way, rows without one last and ties by the given columns the same way; 1 to 500 of them (L3)."""
    order = [F.col(at).desc_nulls_last() if descending else F.col(at).asc_nulls_last(), *[F.col(c).desc() if descending else F.col(c).asc() for c in ties]]
    return rows.orderBy(*order).offset(max(0, offset or 0)).limit(max(1, min(limit or 100, 500)))


def cases_where(cases: DataFrame, events: DataFrame, status: str | None = None, case_type: str | None = None, severity: str | None = None, since: str | None = None, source: str | None = None) -> DataFrame:
    """Cases by what is given of them, and by the source of their event (P8, J10). cases: source, event_id, case_type, severity, status, created_at; events: source, event_id."""
    rows = where_given(cases, status=status, case_type=case_type, severity=severity)
    if since:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return rows.join(where_given(events, source=source).select("source", "event_id"), ["source", "event_id"])


def after(rows: DataFrame, keys: list[tuple[str, bool]], values: list | None, size: int) -> DataFrame:
    """Keyset page: rows after the cursor in the order of keys (name, descending), one more than asked to tell of a next page."""
    if values is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for (name, down), v in zip(keys, values):
            c = F.col(name)
            beyond = beyond | (equal & (c < F.lit(v) if down else c > F.lit(v)))
            equal = equal & (c == F.lit(v))
        rows = rows.where(beyond)
    return rows.orderBy(*[F.col(n).desc() if d else F.col(n).asc() for n, d in keys]).limit(size + 1)


def queue(rows: DataFrame, done_at: str, recency: str, tie: str, limit: int) -> DataFrame:
    """Never done first, then the most recent."""
    return rows.orderBy(F.when(F.col(done_at).isNull(), 0).otherwise(1), F.col(recency).desc_nulls_last(), F.col(tie)).limit(limit)


def of_workspace(rows: DataFrame, members: DataFrame, key: str, workspace: Column | str) -> DataFrame:
    """Rows whose key belongs to the workspace; the filter comes before the join."""
    return rows.join(members.where(F.col("workspace_id") == workspace).select(key), key, "left_semi")


def in_order(rows: DataFrame, wanted: list, key: str) -> DataFrame:
    """Rows of the listed keys in the list's order (J19); the list is an argument, so it is bounded."""
    place = F.create_map(*[F.lit(x) for i, v in enumerate(wanted) for x in (v, i)])
    return rows.where(F.col(key).isin(wanted)).orderBy(place[F.col(key)], key)


def newest(rows: DataFrame, at: str, tie: str, limit: int | None = None) -> DataFrame:
    """Rows by time, the latest first."""
    out = rows.orderBy(F.col(at).desc_nulls_last(), F.col(tie))
    return out.limit(limit) if limit else out


def left_one(rows: DataFrame, others: DataFrame, on: dict[str, str], **fixed) -> DataFrame:
    """Rows with those of ``others`` by the named columns and, of ``others``, constant ones: filtered before the join, so rows stay."""
    for name, value in fixed.items():
        others = others.where(F.col(name) == value)
    return rows.join(others.drop(*fixed), [F.col(a) == F.col(b) for a, b in on.items()], "left")


def shown(rows: DataFrame, shape: dict[str, Column | str]) -> DataFrame:
    """The columns of a response in their order, by name or made."""
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in shape.items()])


def text_or(c: Column, other: Column | str = "") -> Column:
    """The text unless it is null or blank."""
    other = F.lit(other) if isinstance(other, str) else other
    return F.when(F.trim(c) != "", c).otherwise(other)


def message_view(message_type: Column, from_me: Column, text: Column) -> dict[str, Column]:
    """Direction, content and type of a message as the user interface names them."""
    kind = text_or(message_type, "conversation")
    shown_as = F.when(kind.isin("audioMessage", "ptt"), "AUDIO").when(kind == "imageMessage", "IMAGE").when(kind == "documentMessage", "PDF").otherwise("TEXT")
    return {"direction": F.when(from_me, "OUTBOUND").otherwise("INBOUND"), "content": text_or(text, "[sem texto extraído]"), "type": shown_as, "raw_type": kind}


def timeline_view(event_type: Column) -> Column:
    upper = F.upper(text_or(event_type, "SIGNAL"))
    return F.when(F.contains(upper, F.lit("MESSAGE")), "MESSAGE").when(F.contains(upper, F.lit("OPPORT")), "OPPORTUNITY").when(F.contains(upper, F.lit("CONTRACT")), "CONTRACT").when(F.contains(upper, F.lit("PENDING")), "PENDING").otherwise("SIGNAL")


def context(sections: dict[str, DataFrame], subject: str, at: str, tie: str, include: str | None = None, cap: int = 20) -> DataFrame:
    """(subject, section, rank, at, item) for all subjects: the newest ``cap`` rows of each wanted section, an item as JSON.

    ``include`` names sections with commas between, all where it is empty; unknown names are ignored. Only the wanted ones are
    read. With none wanted there are no rows.
    """
    asked = {n.strip() for n in (include or "").split(",") if n.strip()}
    empty = next(iter(sections.values())).where("false")
    wanted = {n: df for n, df in sections.items() if not asked or n in asked} or {"none": empty}
    newest = Window.partitionBy(subject).orderBy(F.desc(at), F.desc(tie))
    parts = []
    for name, df in wanted.items():
        top = df.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= cap)
        parts.append(top.select(subject, F.lit(name).alias("section"), F.col("_rank").alias("rank"), F.col(at).alias("at"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("item")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
