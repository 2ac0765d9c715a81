"""Observations extracted from landed web pages and CSV files.

A page is one row and its table a bounded array, so extraction stays inside the row (regular
expressions and higher-order functions) and shuffles nothing; only the sparse rate table, whose year
and month cells carry down, is exploded and filled by a window per page. A page that does not hold
what is expected yields a row with an error text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.numeric import number_in, rounded, to_number
from tickerloom.functions.text import html_cell_text, page_text, stripped

# Patterns, captions and markers of the supported publications.
POLICY_RATE_PATTERN = r"(?i)Policy\s+Repo\s+Rate\s*:\s*([0-9]+(?:\.[0-9]+)?)\s*%"
UPDATED_PATTERN = r"(?i)Website\s+last\s+updated\s+date\s*:\s*([A-Za-z]{3}\s+\d{1,2},\s+\d{4})"
ROW_PATTERN = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL_PATTERN = r"(?is)<td[^>]*>(.*?)</td>"
ROW_HEADER_PATTERN = r'(?is)<th[^>]*class="row-header"[^>]*>(.*?)</th>'
TABLE_CAPTIONS = {
    "inflation": "All groups CPI, Australia, monthly and annual movement (%)",
    "unemployment": "Unemployment rate",
    "gdp_growth": "Gross domestic product, chain volume measures, seasonally adjusted",
}
RATE_TABLE_MARKER = "ContentPlaceHolder1_soraHeader"
CASH_RATE_SERIES = "FIRMMCRTD"
CSV_PAIR_PATTERN = r'^(?:"([^"]*)"|([^",]*)),(?:"([^"]*)"|([^",]*))'


def page_rate_extract(pages: DataFrame) -> DataFrame:
    """Policy rate and last-updated date (null when it is no date) from a page's visible text."""
    found = pages.select("page_id", page_text(F.col("html")).alias("text")).select(
        "page_id",
        F.regexp_extract("text", POLICY_RATE_PATTERN, 1).alias("rate"),
        F.try_to_date(
            F.initcap(F.regexp_extract("text", UPDATED_PATTERN, 1)), "MMM d, yyyy"
        ).alias("updated"),
    )
    return found.selectExpr("page_id", f"{to_number('rate')} as value", "updated").selectExpr(
        "page_id",
        "value",
        "case when value is not null then date_format(updated, 'yyyy-MM-dd') end"
        " as page_last_updated_date",
        "case when value is null then 'policy rate not found' end as error",
    )


def _latest_row(table: Column, trend_optional: Column) -> Column:
    """Latest row of a table with a date and its two figures: (date, first cell, second cell), else null.

    Rows are read for their dates only; the cells of one row after the other, latest first, are cleaned
    until a row is sound, which ends the fold's work.
    """
    kind = "struct<date:date,first_text:string,second_text:string>"
    dated = F.transform(
        F.regexp_extract_all(table, F.lit(ROW_PATTERN), F.lit(1)),
        lambda row, position: F.struct(
            F.try_to_date(F.initcap(html_cell_text(F.regexp_extract(row, ROW_HEADER_PATTERN, 1))), "MMM-yy").alias("date"),
            (-position).alias("order"),
            row.alias("row"),
        ),
    )
    newest_first = F.sort_array(F.filter(dated, lambda r: r["date"].isNotNull()), asc=False)

    def figures(row: Column, cells: Column) -> Column:
        first, second = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
        sound = number_in(second).isNotNull() & (
            number_in(first).isNotNull() | (trend_optional & (first == ""))
        )
        return F.when(sound, F.struct(row["date"], first.alias("first_text"), second.alias("second_text")))

    def step(best: Column, row: Column) -> Column:
        cells = F.transform(F.regexp_extract_all(row["row"], F.lit(CELL_PATTERN), F.lit(1)), html_cell_text)
        once = F.transform(F.array(cells), lambda c: figures(row, c))  # cells are cleaned once for all uses
        return F.when(best.isNotNull(), best).otherwise(F.get(once, F.lit(0)).cast(kind))

    return F.aggregate(newest_first, F.lit(None).cast(kind), step)


def page_table_extract(pages: DataFrame) -> DataFrame:
    """Latest row of each captioned table, all tables of a page in one pass over it.

    Inflation publishes the annual change (second cell), unemployment the adjusted rate (second cell,
    trend optional), growth the quarterly change (first cell); ``other`` is the remaining cell. A table that
    is missing or breaks off is an error.
    """
    # a table with its caption, from the first mark of it to the next end of a table: one search of the page each
    tables = {i: f"(?s)\\Q<caption>{c}</caption>\\E.*?</table>" for i, c in TABLE_CAPTIONS.items()}
    listed = ", ".join(f"'{i}', {i}" for i in tables)
    found = [F.nullif(F.regexp_extract("html", pattern, 0), F.lit("")).alias(i) for i, pattern in tables.items()]
    picked = (
        pages.select("page_id", *found)
        .selectExpr("page_id", f"stack({len(tables)}, {listed}) as (indicator, found)")
        .select(
            "page_id",
            "indicator",
            F.col("found").isNull().alias("no_table"),
            # an array of one is exploded, so that the row is picked once for all its uses below
            F.explode(F.array(_latest_row(F.col("found"), F.col("indicator") == "unemployment"))).alias("latest"),
        )
    )
    by_quarter = "indicator = 'gdp_growth'"
    return picked.selectExpr(
        "page_id",
        "indicator",
        f"{to_number('latest.first_text')} as first",
        f"{to_number('latest.second_text')} as second",
        f"if({by_quarter}, concat(year(latest.date), '-Q', quarter(latest.date)),"
        " date_format(latest.date, 'yyyy-MM')) as observation_date",
        "case when no_table then 'table not found'"
        " when latest is null then 'no valid observations' end as error",
    ).selectExpr(
        "page_id",
        "indicator",
        f"{rounded(f'if({by_quarter}, first, second)', 2)} as value",
        f"{rounded(f'if({by_quarter}, second, first)', 2)} as other",
        "observation_date",
        "error",
    )


RATE_FIELDS = ["year", "month", "day", "published", "rate"]


def _rate_rows() -> Column:
    """Rows of the sparse rate table as an array of their first five cells; rows with a bad year are dropped."""
    html = F.col("html")
    tail = F.when(
        html.contains(RATE_TABLE_MARKER), html.substr(F.instr(html, RATE_TABLE_MARKER), F.length(html))
    )
    cells = F.transform(
        F.regexp_extract_all(tail, F.lit(ROW_PATTERN), F.lit(1)),
        lambda row, position: F.struct(
            position.alias("position"),
            F.transform(F.regexp_extract_all(row, F.lit(CELL_PATTERN), F.lit(1)), html_cell_text).alias("cells"),
        ),
    )
    sound = F.filter(
        cells, lambda r: (F.size(r["cells"]) >= 5) & F.get(r["cells"], F.lit(0)).rlike("^([+-]?[0-9]+)?$")
    )
    blank = lambda r, i: F.nullif(r["cells"][i], F.lit(""))
    return F.transform(
        sound,
        lambda r: F.struct(
            r["position"].alias("position"),
            *[(r["cells"][i] if n == "published" else blank(r, i)).alias(n) for i, n in enumerate(RATE_FIELDS)],
        ),
    )


def rate_table_rows(pages: DataFrame) -> DataFrame:
    """Rows of the sparse rate table, year and month carried down."""
    rows = pages.select("page_id", F.inline(_rate_rows()))
    return forward_fill(rows, ["page_id"], "position", ["year", "month"])


def forward_fill(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Carry the last non-null value of the columns down each group (a page's rows)."""
    before = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(before) for c in columns})


def sora_table_extract(pages: DataFrame) -> DataFrame:
    """Latest value date with its publication date and rate (4 places) per page.

    Year and month are carried down inside the row, by a fold that keeps the best row so far: one scan, no
    exchange, and a page without a table keeps its row.
    """
    text, best_type = F.lit(None).cast("string"), "struct<value_date:date,publication_date:date,value:double>"
    start = F.struct(text.alias("year"), text.alias("month"), F.lit(None).cast(best_type).alias("best"))

    def step(state: Column, row: Column) -> Column:
        year, month = (F.coalesce(row[n], state[n]) for n in ("year", "month"))
        found = F.struct(
            F.try_to_date(F.concat_ws(" ", year, F.initcap(month), row["day"]), "yyyy MMM d").alias("value_date"),
            F.try_to_date(F.initcap(row["published"]), "d MMM yyyy").alias("publication_date"),
            row["value"].alias("value"),
        )
        whole = year.isNotNull() & month.isNotNull() & row["day"].isNotNull()
        sound = whole & found["value_date"].isNotNull() & found["publication_date"].isNotNull() & row["value"].isNotNull()
        better = state["best"].isNull() | (found["value_date"] > state["best"]["value_date"])
        best = F.when(sound & better, found).otherwise(state["best"])
        return F.struct(year.alias("year"), month.alias("month"), best.alias("best"))

    valued = f"transform(rows, r -> struct(r.year, r.month, r.day, r.published, {to_number('r.rate')} as value))"
    latest = (
        pages.select("page_id", F.explode(F.array(_rate_rows())).alias("rows"))
        .selectExpr("page_id", f"{valued} as rows")
        .select("page_id", F.aggregate(F.coalesce("rows", F.array()), start, step)["best"].alias("latest"))
    )
    return latest.selectExpr(
        "page_id",
        f"{rounded('latest.value', 4)} as value",
        "date_format(latest.value_date, 'yyyy-MM-dd') as observation_date",
        "date_format(latest.publication_date, 'yyyy-MM-dd') as publication_date",
        "case when latest is null then 'no valid observations' end as error",
    )


def rba_csv_extract(files: DataFrame) -> DataFrame:
    """Latest cash rate of CSV files with a preamble (``file, content``): data starts after the
    series-id line, which must name the expected series."""
    lines = F.split(F.regexp_replace("content", "^\\uFEFF", ""), "\r?\n")

    def pair(line: Column, position: Column) -> Column:
        def field(quoted: int) -> Column:
            return stripped(
                F.concat(
                    F.regexp_extract(line, CSV_PAIR_PATTERN, quoted),
                    F.regexp_extract(line, CSV_PAIR_PATTERN, quoted + 1),
                )
            )

        return F.when(
            line.contains(","),
            F.struct(field(1).alias("name"), field(3).alias("text"), (-position).alias("order")),
        )

    pairs = F.filter(F.transform(lines, pair), lambda p: p.isNotNull())
    parsed = (
        files.select("file", pairs.alias("pairs"))
        .selectExpr("*", "int(array_position(pairs.name, 'Series ID')) as start")
        .selectExpr(
            "file",
            "start",
            "try_element_at(pairs.text, nullif(start, 0)) as series_id",
            "try_element_at(filter(slice(pairs, 1, greatest(start - 1, 0)),"
            " p -> p.name = 'Publication date'), -1).text as published",
            "array_max(filter(transform(if(start > 0, slice(pairs, start + 1, size(pairs)), null), p -> struct("
            "try_to_date(initcap(p.name), 'd-MMM-yyyy') as date, p.order as order,"
            f" {to_number('p.text')} as value)),"
            " o -> o.date is not null and o.value is not null)) as latest",
        )
        .selectExpr(
            "*",
            "case when start = 0 then 'data section not found'"
            f" when series_id <> '{CASH_RATE_SERIES}' then 'unexpected series'"
            " when latest is null then 'no valid observations' end as error",
        )
    )
    published = "coalesce(date_format(try_to_date(initcap(published), 'd-MMM-yyyy'), 'yyyy-MM-dd'), published)"
    return parsed.selectExpr(
        "file",
        f"case when error is null then {rounded('latest.value', 2)} end as value",
        "case when error is null then date_format(latest.date, 'yyyy-MM-dd') end as observation_date",
        f"case when error is null then {published} end as publication_date",
        "error",
    )
