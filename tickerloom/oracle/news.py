"""Oracles for news, sentiment and company lookup."""

from __future__ import annotations

from tickerloom.functions.markets import NEWS_OVERRIDES
from tickerloom.functions.text import BLOCKED_HEADLINE_PHRASES
from tickerloom.operators.resolve import IGNORED_WORDS
from tickerloom.oracle.views import market, r, symbol
from tickerloom.sources.views import BRANDS

_WS = "E' \\t\\r\\n'"
_OVERRIDES = ", ".join(f"('{s}', '{n}', {t})" for s, n, t in NEWS_OVERRIDES)
_BLOCKED = " or ".join(f"contains(lower(headline), '{p}')" for p in BLOCKED_HEADLINE_PHRASES)
_IGNORED = ", ".join(f"'{w}'" for w in IGNORED_WORDS)
_NORMAL = (
    f"case when lower(trim(sentiment, {_WS})) in ('positive', 'negative')"
    f" then lower(trim(sentiment, {_WS})) else 'neutral' end"
)
_CLASSES = ("positive", "neutral", "negative")
_ORDER = ("negative", "neutral", "positive")
_PER_CLASS = ", ".join(f"count_if(label = '{c}') as n_{c}" for c in _ORDER)


def _micro(probability: str) -> str:
    return f"cast(round(ln({probability}) * 1000000) as bigint)"


def features(symbols: str, classified: str) -> str:
    counts = ", ".join(f"cast(count_if(label = '{c}') as bigint) as {c}_count" for c in _CLASSES)
    return f"""
select s.symbol, coalesce(n, 0) as article_count,
  {", ".join(f"coalesce({c}_count, 0) as {c}_count" for c in _CLASSES)},
  {", ".join(f"coalesce({r(f'{c}_count / n', 4)}, 0) as {c}_ratio" for c in _CLASSES)},
  coalesce({r("(positive_count - negative_count) / n", 4)}, 0) as sentiment_score,
  case when (positive_count - negative_count) / n > 0.2 then 'POSITIVE'
    when (positive_count - negative_count) / n < -0.2 then 'NEGATIVE' else 'NEUTRAL' end as overall_sentiment
from {symbols} s left join (select symbol, count(*) as n, {counts}
  from (select symbol, {_NORMAL} as label from {classified}) group by symbol) c on c.symbol = s.symbol"""


def scored(articles: str, terms: str) -> str:
    return f"""
select a.*, coalesce(list_sum(list_transform(terms, lambda t:
    case when contains(lower(coalesce(title, '')), t) then 10 else 0 end
    + case when contains(lower(coalesce(description, '')), t) then 4 else 0 end
    + case when contains(lower(coalesce(content, '')), t) then 1 else 0 end)), 0) as relevance_score
from (select *, trim(title, {_WS}) as headline from {articles}) a join {terms} t on t.symbol = a.symbol
where trim(title, {_WS}) <> '' and not ({_BLOCKED})"""


def deduplicated(articles: str) -> str:
    kind = "struct(rk bigint, title_key varchar, url varchar, doc_id bigint, relevance_score bigint)"
    return f"""
select symbol, k.doc_id, k.url, k.relevance_score, i as rank from (
  select symbol, unnest(kept) as k, unnest(range(1, len(kept) + 1)) as i from (
    select symbol, list_reduce(list([item] order by item.rk), lambda kept, x:
      case when x[1].url = '' or len(list_filter(kept, lambda z: z.title_key = x[1].title_key
        or z.url = x[1].url)) > 0 then kept else list_concat(kept, x) end, []::{kind}[]) as kept
    from (select symbol, {{'rk': row_number() over (partition by symbol order by relevance_score desc, published_at desc, doc_id),
        'title_key': lower(headline), 'url': trim(url, {_WS}), 'doc_id': doc_id,
        'relevance_score': cast(relevance_score as bigint)}}::{kind} as item
      from {articles} where relevance_score >= 8)
    group by symbol))"""


_VALID = """(regexp_full_match(upper(trim(search_text)), '[A-Z0-9][A-Z0-9&-]{0,19}(\\.(NS|BO|SI|AX))?')
    or regexp_full_match(upper(trim(search_text)), '[A-Z0-9][A-Z0-9 .&\'\'()-]{1,79}'))"""


def selection(rows: str) -> str:
    return f"""
select query_key, listed from (
  select *, row_number() over (partition by query_key order by rank, result_pos, listed) as k from (
    select upper(query) as query_key, result_pos, upper(trim(symbol)) as listed,
      case when upper(symbol) like '%.NS' then 0 when upper(symbol) like '%.SI' then 1
        when upper(symbol) like '%.AX' then 2
        when symbol <> '' and (upper(symbol) = upper(query) or upper(trim(display_symbol)) = upper(query)) then 3
        when symbol <> '' then 4 end as rank from {rows}) where rank is not null) where k = 1"""


def search_queries(names: str, key: str) -> str:
    return f"""
select {key}, row_number() over (partition by {key} order by pos) - 1 as query_pos, query
from (select *, row_number() over (partition by {key}, upper(query) order by pos) as k from (
  select {key}, 0 as pos, name as query from {names}
  union all select {key}, 1, array_to_string(words, ' ') from {names}
  union all select {key}, 2, case when len(words) > 1 then
    array_to_string(list_transform(words, lambda w: w[1]), '') else '' end from {names}
  union all select {key}, 3, coalesce(words[1], '') from {names}) where query <> '') where k = 1"""


CTES = {
    "term_rows": f"""
select c.symbol, coalesce(o.search_name, c.company_name) as search_name,
  coalesce(o.terms, [lower(c.company_name)]) as terms
from companies c left join (values {_OVERRIDES}) o(symbol, search_name, terms) on o.symbol = c.symbol""",
    "candidates": """
select * from (select *, row_number() over (partition by symbol order by published_at desc, doc_id) as position
  from news) where position <= 100""",
    "all_scored": scored("news", "term_rows"),
    "deduped": deduplicated("all_scored"),
    "headline_words": f"""
select distinct doc_id, {_NORMAL} as label, w as word
from (select *, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as w
  from news join sentiment_labels l using (doc_id) where trim(title, {_WS}) <> '')""",
    "word_counts": f"select word, {_PER_CLASS} from headline_words group by word",
    "word_weights": f"""
select word, {", ".join(f"{_micro(f'(n_{c} + 1.0::double) / (sum(n_{c}) over () + count(*) over ())')} as w_{c}" for c in _ORDER)}
from word_counts""",
    "class_weights": f"""
select {", ".join(f"{_micro(f'(n_{c} + 1.0::double) / (n + 3)')} as p_{c}" for c in _ORDER)}
from (select count(*) as n, {_PER_CLASS} from (select {_NORMAL} as label
  from news join sentiment_labels l using (doc_id) where trim(title, {_WS}) <> ''))""",
    "predicted": f"""
select doc_id, case when blank then 'neutral' when negative >= neutral and negative >= positive then 'negative'
  when neutral >= positive then 'neutral' else 'positive' end as sentiment
from (select n.doc_id, trim(n.title, {_WS}) = '' as blank,
    {", ".join(f"coalesce(s_{c}, 0) + p_{c} as {c}" for c in _ORDER)}
  from news n left join (select doc_id, {", ".join(f"sum(w_{c}) as s_{c}" for c in _ORDER)}
      from (select distinct doc_id, w as word
        from (select doc_id, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as w from news))
      join word_weights using (word) group by doc_id) x on x.doc_id = n.doc_id cross join class_weights)""",
    "story_classes": "select symbol, sentiment from deduped join predicted using (doc_id) where rank <= 5",
    "labelled_news": "select n.symbol, n.doc_id, sentiment from news n join sentiment_labels l using (doc_id)",
    "named_companies": """
select company_key, legal_name as name,
  list_filter(regexp_extract_all(legal_name, '[A-Za-z0-9]+'),
    lambda w: lower(w) not in (%s)) as words from companies"""
    % _IGNORED,
    "query_rows": search_queries("named_companies", "company_key"),
    "requests": f"""
select c_custkey, case c_custkey % 4 when 0 then lower({symbol("c_custkey")})
  when 1 then '  the ' || list_extract([{", ".join(f"'{b}'" for b in BRANDS)}], cast(c_custkey % 7 + 1 as int)) || '  company ltd'
  when 2 then '-bad' else c_name end as search_text from customer""",
    "typed_requests": f"""
select *, regexp_replace(trim(search_text), '\\s+', ' ', 'g') as name, upper(trim(search_text)) as typed,
  {_VALID} as valid from requests""",
    "request_names": f"""
select c_custkey, name, list_filter(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda w: lower(w) not in ({_IGNORED})) as words
from typed_requests where valid""",
    "request_queries": search_queries("request_names", "c_custkey"),
    "request_symbols": """
select c_custkey, arg_min(listed, query_pos) filter (listed is not null) as by_name
from request_queries left join selected on query_key = upper(query) group by c_custkey""",
    "listing_rows": """
select q as query, company_key as result_pos,
  case when company_key % 16 = 5 then '' when company_key % 2 = 1 then lower(symbol) else symbol end as symbol,
  case when company_key % 12 = 4 then ' ' || upper(q) end as display_symbol
from (select company_key, symbol, case when company_key % 7 < 5 then lower(company_name) end as q from companies
  union all select company_key, symbol, case when company_key % 3 = 0 then
    legal_name[1] || string_split(legal_name, ' ')[2][1] || 'S' end from companies
  union all select company_key, symbol, case when company_key % 10 = 0 then legal_name end from companies)
where q is not null""",
    "selected": selection("listing_rows"),
    "listed_names": """
select company_key as listing, case when company_key % 9 = 4 then company_name else legal_name end as name,
  case when company_key % 16 = 5 then '' when company_key % 2 = 1 then lower(symbol) else symbol end as symbol,
  case when company_key % 12 = 4 then ' ' || upper(company_name) end as display_symbol from companies""",
    "search_hits": """
select q.query, least(len(lw) - len(qw), 15) * 68719476736 + listing as result_pos, symbol, display_symbol
from (select distinct upper(query) as query, list_distinct(regexp_extract_all(upper(query), '[A-Z0-9]+')) as qw from query_rows) q
join (select *, list_distinct(regexp_extract_all(upper(name), '[A-Z0-9]+')) as lw from listed_names) l
  on len(qw) > 0 and len(list_filter(qw, lambda w: not list_contains(lw, w))) = 0""",
    "selected_hits": selection("search_hits"),
    "search_texts": f"""
select c_custkey, case c_custkey % 8 when 0 then lower({symbol("c_custkey")}) when 1 then c_name
  when 2 then '  ' || c_mktsegment || ' ' when 3 then 'Tata & Sons (' || c_mktsegment || ')'
  when 4 then '-bad' when 5 then '' when 6 then repeat(c_mktsegment, 12) else 'x' end as search_text
from customer""",
}

QUERIES = {
    "news_payload": """
select symbol, title, description, content, source, published_at, url from news
where (doc_id // 300) % 5 <> 4""",
    "headline_filter": f"""
select symbol, doc_id, headline from (select *, trim(title, {_WS}) as headline from news)
where headline <> '' and not ({_BLOCKED})""",
    "company_search_name": "select symbol, search_name from term_rows",
    "company_terms": "select symbol, unnest(terms) as term from term_rows",
    "term_article_join": """
select n.symbol, doc_id, term, contains(lower(title), term) as in_title,
  contains(lower(coalesce(description, '')), term) as in_description,
  contains(lower(content), term) as in_content
from news n join (select symbol, unnest(terms) as term from term_rows) t on t.symbol = n.symbol""",
    "relevance_score": """
select symbol, doc_id, cast(relevance_score as int) as relevance_score from all_scored
where relevance_score >= 8""",
    "candidate_cap": "select symbol, doc_id, position, published_at from candidates",
    "candidate_cap_ranked": "select symbol, doc_id, position, published_at from candidates",
    "news_dedup": "select symbol, rank, doc_id, url, relevance_score from deduped",
    "sentiment_predict": "select doc_id, sentiment from predicted",
    "company_sentiment": features("companies", "story_classes"),
    "news_topk": f"""
select d.symbol, d.rank, d.doc_id, d.url, d.relevance_score, headline,
  trim(coalesce(description, ''), {_WS}) as description, source, published_at
from deduped d join all_scored c on c.doc_id = d.doc_id where rank <= 5""",
    "sentiment_normalize": f"select doc_id, {_NORMAL} as sentiment from sentiment_labels",
    "sentiment_features": features("companies", "labelled_news"),
    "search_input_valid": """
select c_custkey, search_text,
  regexp_full_match(upper(trim(search_text)), '[A-Z0-9][A-Z0-9&-]{0,19}(\\.(NS|BO|SI|AX))?')
    or regexp_full_match(upper(trim(search_text)), '[A-Z0-9][A-Z0-9 .&''()-]{1,79}') as is_valid
from search_texts""",
    "company_queries": "select company_key, query_pos, query from query_rows",
    "symbol_select": "select * from selected",
    "company_resolve": """
select company_key, arg_min(listed, query_pos) filter (listed is not null) as symbol
from query_rows left join selected on query_key = upper(query) group by company_key""",
    "company_search": """
select company_key, arg_min(listed, query_pos) filter (listed is not null) as symbol
from query_rows left join selected_hits on query_key = upper(query) group by company_key""",
    "term_mentions": """
select * from (
  select doc_id, term, contains(lower(coalesce(title, '')), term) as in_title,
    contains(lower(coalesce(description, '')), term) as in_description, contains(lower(coalesce(content, '')), term) as in_content
  from news, (select distinct lower(t) as term from (select unnest(terms) as t from term_rows)))
where in_title or in_description or in_content""",
    "headline_idf": f"""
select word, count(*) as headlines, {r("ln((any_value(n) + 1) / (count(*) + 1))", 6)} as idf
from (select distinct doc_id, w as word, n from (
  select *, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as w from (
    select doc_id, title, count(*) over () as n from news join sentiment_labels l using (doc_id) where trim(title, {_WS}) <> '')))
group by word""",
    "symbols_rejected": f"""
select s as symbol from (select {symbol("c_custkey")} as s, {market("c_custkey")} as m from customer)
where s not in (select symbol from trades_2y where ts <= timestamp '2001-11-05')
  and s not in (select symbol from fundamental_records where company_name is not null)""",
}
