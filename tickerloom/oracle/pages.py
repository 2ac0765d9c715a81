"""Oracles for extraction from pages and files: expected values by arithmetic, not by parsing."""

from __future__ import annotations

from tickerloom.oracle.views import r

_ENTITIES = [("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("copy", "©"),
             ("middot", "·"), ("amp", "&")]


def cell_text(html: str) -> str:
    text = f"regexp_replace({html}, '<[^>]+>', ' ', 'g')"
    for name, char in _ENTITIES:
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return f"trim(regexp_replace({text}, '[ \\t\\r\\n\\f\\x{{00a0}}]+', ' ', 'g'))"


def _tenths(value: str) -> str:
    return f"cast(({value}) / 10 as double)"


CTES = {
    "table_rows": f"""
select page_id, m, date '2025-01-01' + to_months(cast(m as int)) as month,
  (page_id + m) % 5 = 0 as first_blank, (page_id + m) % 9 = 4 as first_bad,
  (page_id + 2 * m) % 7 = 0 as second_blank,
  {_tenths("(page_id * 7 + m * 3) % 40 - 10")} as c1, {_tenths("(page_id * 5 + m * 11) % 60 - 15")} as c2
from pages, (select unnest(range(12)) as m) where page_id % 8 <> 0""",
    "table_valid": """
select 'inflation' as indicator, page_id, month, c2 as value, c1 as other, strftime(month, '%Y-%m') as label
from table_rows where not first_blank and not first_bad and not second_blank
union all
select 'unemployment', page_id, month, c2, case when not first_blank then c1 end, strftime(month, '%Y-%m')
from table_rows where (first_blank or not first_bad) and not second_blank
union all
select 'gdp_growth', page_id, month, c1, c2, year(month) || '-Q' || quarter(month)
from table_rows where not first_blank and not first_bad and not second_blank and page_id % 8 <> 1""",
    "table_latest": """
select * from (select *, row_number() over (partition by indicator, page_id order by month desc) as k
  from table_valid) where k = 1""",
    "sora_days": """
select page_id, i, date '2025-11-20' + cast(i * 4 + page_id % 5 as int) as d
from pages, (select unnest(range(24)) as i) where page_id % 9 <> 0""",
    "sora_cells": """
select page_id, i, d, case when (page_id + i) % 11 = 7 then 'xx'
    when i = 0 or year(d) <> year(d - 4) then cast(year(d) as varchar) end as year,
  case when i = 0 or month(d) <> month(d - 4) then strftime(d, '%b') end as month, day(d) as day,
  (page_id + i) % 13 <> 5 as published, (page_id + i) % 6 <> 2 as rated, i % 10 <> 9 as complete,
  ((page_id * 3 + i * 7) % 400) / 100 as rate
from sora_days""",
    "sora_filled": """
select * replace (
  last_value(year ignore nulls) over w as year, last_value(month ignore nulls) over w as month)
from sora_cells where complete and coalesce(year, '') <> 'xx'
window w as (partition by page_id order by i rows unbounded preceding)""",
    "sora_latest": """
select * from (select *, row_number() over (partition by page_id order by value_date desc, i) as k
  from (select *, try_strptime(year || ' ' || month || ' ' || day, '%Y %b %d') as value_date from sora_filled
    where published and rated) where value_date is not null) where k = 1""",
    "rate_file_days": """
select o_custkey as c, cast(o_orderdate as date) as d,
  (max(cast(round(o_totalprice * 100) as bigint)) // 10000) / 100 as rate
from orders group by 1, 2""",
}

QUERIES = {
    "html_cell_text": f"select page_id, {cell_text('html')} as cell_text from pages",
    "page_rate_extract": """
select page_id, value, case when value is not null and page_id % 7 <> 0 and page_id % 5 <> 0
    then strftime(date '2026-01-01' + cast(page_id % 300 as int), '%Y-%m-%d') end as page_last_updated_date,
  case when value is null then 'policy rate not found' end as error
from (select page_id, case when page_id % 6 = 0 then null when page_id % 4 = 0 then cast(page_id % 13 as double)
    else cast((page_id % 13) || '.' || lpad(cast((page_id * 7) % 100 as varchar), 2, '0') as double) end as value
  from pages)""",
    "page_table_extract": f"""
select p.page_id, n.indicator, {r("value", 2)} as value, {r("other", 2)} as other, label as observation_date,
  case when p.page_id % 8 = 0 or (n.indicator = 'gdp_growth' and p.page_id % 8 = 1) then 'table not found'
    when t.page_id is null then 'no valid observations' end as error
from pages p cross join (values ('inflation'), ('unemployment'), ('gdp_growth')) n(indicator)
left join table_latest t on t.page_id = p.page_id and t.indicator = n.indicator""",
    "sora_table_extract": f"""
select p.page_id, {r("rate", 4)} as value, strftime(value_date, '%Y-%m-%d') as observation_date,
  strftime(d + 1, '%Y-%m-%d') as publication_date,
  case when s.page_id is null then 'no valid observations' end as error
from pages p left join sora_latest s on s.page_id = p.page_id""",
    "forward_fill": """
select page_id, i as position, year, month, cast(day as varchar) as day from sora_filled""",
    "rba_csv_extract": f"""
select 'F' || f.c as file, case when error is null then {r("rate", 2)} end as value,
  case when error is null then strftime(d, '%Y-%m-%d') end as observation_date,
  case when error is null then case when f.c % 5 = 0 then 'soon' else '2001-11-05' end end as publication_date,
  error
from (select f.c, case when f.c % 11 = 0 then 'data section not found'
    when f.c % 7 = 0 then 'unexpected series' when l.c is null then 'no valid observations' end as error,
    rate, d
  from (select distinct c from rate_file_days) f
  left join (select *, row_number() over (partition by c order by d desc) as k from rate_file_days
    where day(d) not in (3, 4)) l on l.c = f.c and k = 1) f""",
}
