"""Queries over pages, addresses and crawl logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import net
from lectern.operators import guards, html
from lectern.plans import duck, ingest
from lectern.plans.inputs import cte, derive, sql, table
from lectern.plans.registry import query
from lectern.session import work_folder

_MESS = "case page_id % 6 when 0 then url when 1 then replace(url, 'http', 'ftp') when 2 then concat('not a url ', url) when 3 then upper(url) when 4 then '' else url end"


@query(
    "f5_guard_url",
    f"select page_id, {_MESS} as url, case when page_id % 6 in (1, 2, 4) then 'INVALID_URL' end as error_code, "
    f"case page_id % 6 when 1 then '{guards.MESSAGES['BAD_SCHEME']}' when 2 then '{guards.MESSAGES['MALFORMED_URL']}' when 4 then '{guards.MESSAGES['MALFORMED_URL']}' end as error_message from pages",
)
def _(spark, d):
    return guards.guard_url(sql(spark, d, f"select page_id, {_MESS} as url from {{pages}}"))


_VERDICT = """case when status >= 300 and status < 400 and coalesce(location, '') = '' then 'Redirect response is missing location header.'
 when status >= 300 and status < 400 then null when status < 200 or status >= 300 then concat('Origin responded with status ', cast(status as varchar), '.')
 when not contains(lower(content_type), 'text/html') then 'Response is not HTML content.' when n_bytes > 2097152 then 'Response exceeded 2097152 bytes.' end"""


@query(
    "f7_classify_fetch",
    f"with {cte('crawl_log')}, v as (select *, {_VERDICT} as error_message from crawl_log) select page_id, "
    "case when error_message is not null then 'error' when status between 300 and 399 then 'redirect' else 'ok' end as verdict, "
    "case when error_message is not null then 'UNREADABLE_CONTENT' end as error_code, error_message from v",
)
def _(spark, d):
    return guards.classify_fetch(derive(spark, d, "crawl_log")).select("page_id", "verdict", "error_code", "error_message")


@query(
    "f7_classify_fetch_failures",
    "select page_id, case page_id % 4 when 0 then 'FETCH_TIMEOUT' when 3 then null else 'UNREADABLE_CONTENT' end as error_code, "
    "case page_id % 4 when 0 then 'Request timed out after 8000ms.' when 3 then null else 'Fetch failed.' end as error_message from pages",
)
def _(spark, d):
    failing = "case page_id % 4 when 0 then 'timeout' when 1 then 'reset' end"
    log = sql(
        spark, d,
        f"select page_id, case when page_id % 4 = 3 then 200 end as status, cast(null as string) as location, 'Text/HTML' as content_type, 10 as n_bytes, {failing} as failure from {{pages}}",
    )
    return guards.classify_fetch(log).select("page_id", "error_code", "error_message")


@query(
    "j7_resolve_redirects",
    f"""with recursive {cte('crawl_log')}, v as (select *, {_VERDICT} as m from crawl_log),
w as (select url as beg, url as cur, 0 as hops from v union all
 select w.beg, v.location, w.hops + 1 from w join v on v.url = w.cur where v.status between 300 and 399 and v.m is null and w.hops < 5),
e as (select beg as url, cur as final_url, hops from w qualify row_number() over (partition by beg order by hops desc) = 1)
select e.url, e.final_url, hops, case when v.m is null and v.status = 200 then 'ok' else 'error' end as verdict,
 case when v.m is null and v.status = 200 then null when e.final_url like 'http://10.%' then 'BLOCKED_HOST' else 'UNREADABLE_CONTENT' end as error_code,
 case when e.final_url like 'http://10.%' then 'Target host resolves to a blocked IP range.' when e.final_url like 'https://quiet%' then 'Unable to resolve hostname.' when v.url is null then 'Fetch failed.' when v.m is not null then v.m when v.status between 300 and 399 then 'Maximum redirects exceeded.' end as error_message
from e left join v on v.url = e.final_url""",
)
def _(spark, d):
    dns = sql(spark, d, _CRAWL_DNS)
    return guards.resolve_redirects(derive(spark, d, "crawl_log"), dns=dns, cidr=guards.cidr_ranges(spark), folder=work_folder(spark, "crawl"))


# A page's host has one public address; the host `mixed` also has a private one.
_CRAWL_DNS = (
    "select distinct 'c.example' as host, '93.184.216.34' as address from {pages} union all "
    "select distinct concat('h', cast(page_id % 5 as varchar(20)), '.example') as host, '93.184.216.35' as address from {pages} union all "
    "select distinct 'h3.example' as host, '192.168.0.7' as address from {pages}"
)
_SITE = "concat('https://h', cast(page_id % 5 as varchar(20)), '.example/', cast(page_id as varchar(20)))"


@query(
    "crawl_to_articles",
    f"select concat('https://h', cast(page_id % 5 as varchar), '.example/', cast(page_id as varchar)) as url, "
    "case when page_id % 6 = 1 then concat('https://h', cast((page_id + 1) % 5 as varchar), '.example/', cast(page_id + 1 as varchar)) else concat('https://h', cast(page_id % 5 as varchar), '.example/', cast(page_id as varchar)) end as final_url, "
    "1 as n_segments from pages where page_id % 5 <> 3 and page_id % 6 <> 3 and (page_id % 6 <> 1 or ((page_id + 1) % 5 <> 3 and page_id < (select max(page_id) from pages)))",
)
def _(spark, d):
    """Pages behind redirects and forbidden hosts, to article documents."""
    log = sql(
        spark, d,
        f"select {_SITE} as url, case page_id % 6 when 1 then 301 when 3 then 404 else 200 end as status, "
        "case when page_id % 6 = 1 then concat('https://h', cast((page_id + 1) % 5 as varchar(20)), '.example/', cast(page_id + 1 as varchar(20))) end as location, "
        "'text/html' as content_type, 10 as n_bytes from {pages}",
    )
    bodies = sql(spark, d, f"select {_SITE} as url, html from {{pages}}")
    found = ingest.read_crawl(log, sql(spark, d, _CRAWL_DNS), guards.cidr_ranges(spark), bodies, work_folder(spark, "crawl"))
    return found.select("url", "final_url", F.size("segments").alias("n_segments"))


_V4 = "(split_part(q, '.', 1)::bigint * 16777216 + split_part(q, '.', 2)::bigint * 65536 + split_part(q, '.', 3)::bigint * 256 + split_part(q, '.', 4)::bigint)"
_QUAD = "regexp_extract(address, '(\\d+\\.\\d+\\.\\d+\\.\\d+)$', 1)"
# The test addresses hold no other IPv6 form than a shortened link-local one.
_BLOCKED = f"""case when q <> '' then ({_V4} between 0 and 16777215 or {_V4} between 167772160 and 184549375 or {_V4} between 2130706432 and 2147483647
 or {_V4} between 2851995648 and 2852061183 or {_V4} between 2886729728 and 2887778303 or {_V4} between 3232235520 and 3232301055)
 when starts_with(address, 'fe80::') then true when contains(address, ':') then false else true end"""
# A wider spread of addresses than a handful of constants: one per page and octet pattern.
_ADDRESSES = (
    "select page_id, case page_id % 9 when 0 then concat('10.', cast(page_id % 256 as varchar(20)), '.', cast(page_id % 199 as varchar(20)), '.1') "
    "when 1 then concat('172.', cast(page_id % 64 as varchar(20)), '.2.3') when 2 then concat(cast(page_id % 256 as varchar(20)), '.168.4.', cast(page_id % 250 as varchar(20))) "
    "when 3 then concat('::ffff:127.0.0.', cast(page_id % 256 as varchar(20))) when 4 then concat('fe80::', cast(page_id % 9999 as varchar(20))) "
    "when 5 then concat('2001:db8::', cast(page_id % 9999 as varchar(20))) when 6 then 'no address' when 7 then concat('192.168.', cast(page_id % 256 as varchar(20)), '.7') "
    "else concat('169.', cast(page_id % 256 as varchar(20)), '.1.1') end as address from {pages} union all "
    "select page_id, address from {dns}"
)


@query(
    "j5_block_private_hosts",
    f"with {cte('dns')}, a as ({_ADDRESSES.replace('{', '').replace('}', '')}), b as (select *, {_QUAD} as q from a) select page_id, address from b where {_BLOCKED}",
)
def _(spark, d):
    return guards.block_private_hosts(sql(spark, d, _ADDRESSES), guards.cidr_ranges(spark))


@query(
    "x22_address_keys",
    f"with {cte('dns')}, a as ({_ADDRESSES.replace('{', '').replace('}', '')}), b as (select *, {_QUAD} as q from a) select page_id, address, "
    f"case when q <> '' and not contains(address, ':') then {_V4} end as v4, "
    f"case when starts_with(address, '::ffff:') then concat('00000000000000000000ffff', printf('%08x', {_V4})) "
    "when starts_with(address, 'fe80::') then concat('fe80000000000000000000000000', lpad(substr(address, 7), 4, '0')) "
    "when starts_with(address, '2001:db8::') then concat('20010db800000000000000000000', lpad(substr(address, 11), 4, '0')) end as v6 from b",
)
def _(spark, d):
    address = F.col("address")
    return sql(spark, d, _ADDRESSES).select(
        "page_id", "address", net.ipv4_to_long(address).alias("v4"), net.ipv6_to_hex(address).alias("v6")
    )


_HOST = "case page_id % 8 when 0 then '10.1.2.3' when 1 then '[fe80::1]' when 2 then '8.8.8.8' else concat('h', cast(page_id as varchar(20)), '.example') end"


@query(
    "j6_host_verdict",
    f"""with {cte('dns')}, b as (select page_id, bool_or({_BLOCKED}) as bad from (select *, {_QUAD} as q from dns) group by page_id),
v as (select p.page_id, case page_id % 8 when 0 then '10.1.2.3' when 1 then 'fe80::1' when 2 then '8.8.8.8' else concat('h', cast(page_id as varchar), '.example') end as host,
 case page_id % 8 when 0 then true when 1 then true when 2 then false else coalesce(b.bad, false) end as bad, page_id % 8 > 2 and b.bad is null as silent from pages p left join b using (page_id))
select page_id, host, case when bad then 'BLOCKED_HOST' when silent then 'UNREADABLE_CONTENT' end as error_code,
case when bad then '{guards.MESSAGES['BLOCKED_HOST']}' when silent then '{guards.MESSAGES['UNRESOLVED']}' end as error_message from v""",
)
def _(spark, d):
    urls = sql(spark, d, f"select page_id, concat('http://', {_HOST}, ':8080/x') as url from {{pages}}")
    hosts = urls.select("page_id", net.url_host(F.col("url")).alias("host"))
    dns = sql(spark, d, "select concat('h', cast(page_id as varchar(20)), '.example') as host, address from {dns}")
    return guards.host_verdict(hosts, dns, guards.cidr_ranges(spark))


@query(
    "f8_validate_article",
    f"select page_id, case when page_id % 5 = 0 then '' else {duck.page_title('html')} end as title, {duck.trim('case when page_id % 7 = 0 then chr(160) else concat(chr(9), url, chr(10)) end')} as text_content, "
    f"case when page_id % 5 = 0 or page_id % 7 = 0 or {duck.page_title('html')} is null then 'UNREADABLE_CONTENT' when page_id % 3 = 0 then 'INVALID_URL' end as error_code from pages",
)
def _(spark, d):
    articles = table(spark, d, "pages").select(
        "page_id",
        F.when(F.col("page_id") % 5 == 0, "").otherwise(html.page_title(F.col("html"))).alias("title"),
        F.when(F.col("page_id") % 7 == 0, "\u00a0").otherwise(F.concat(F.lit("\t"), "url", F.lit("\n"))).alias("text_content"),
        F.when(F.col("page_id") % 3 == 0, "").alias("byline"),
        F.lit("x").alias("excerpt"),
        F.lit(None).cast("string").alias("site_name"),
    )
    return guards.validate_article(articles).select("page_id", "title", "text_content", "error_code")


@query(
    "f9_map_error_status",
    "select page_id, code as error_code, case when page_id % 7 <> 0 then s end as status, case when page_id % 7 = 0 then 'URL_EXTRACT_UNAVAILABLE' when s = 404 or s >= 500 then 'URL_EXTRACT_UNAVAILABLE' "
    "when s < 200 or s >= 300 then 'URL_EXTRACT_FAILED' end as client_code from (select page_id, code, case when code is null then 200 when code = 'BAD_BODY' then 400 when code = 'FETCH_TIMEOUT' then 504 else 422 end as s from "
    "(select page_id, case page_id % 5 when 0 then 'BAD_BODY' when 1 then 'FETCH_TIMEOUT' when 2 then 'BLOCKED_HOST' when 3 then 'UNREADABLE_CONTENT' end as code from pages))",
)
def _(spark, d):
    rows = sql(
        spark, d,
        "select page_id, case page_id % 5 when 0 then 'BAD_BODY' when 1 then 'FETCH_TIMEOUT' when 2 then 'BLOCKED_HOST' when 3 then 'UNREADABLE_CONTENT' end as error_code, page_id % 7 <> 0 as responded from {pages}",
    )
    return guards.map_error_status(rows).drop("responded")


@query(
    "u13_asset_refs",
    f"""with {cte('dirty_pages')}, h as (select page_id, url, replace(html, '</footer>', case page_id % 3 when 0 then '<script async src=''https://cdn.example/assets/lib.js#x''></script><script src="data:text/js,1"></script>'
 when 1 then '<link rel=x href="../assets/up.css"><script src="/assets/a.js"></script>' else '<script src="/static/c.js"></script>' end) as html from dirty_pages where page_id % 4 <> 0
 union all select page_id, url, html from pages where page_id % 4 = 0),
r as (select distinct page_id, url, unnest(list_concat(list_filter(regexp_extract_all(html, '(?i)<(?:script[^>]*\\ssrc|link[^>]*\\shref)=[''"]([^''"]+)[''"][^>]*>', 1),
 lambda x: not starts_with(x, 'data:') and contains(x, '/assets/') and regexp_matches(x, '(?i)\\.(?:js|css)(?:\\?|#|$)')), case when page_id % 4 = 0 then [null] else [] end)) as ref from h),
f as (select page_id, ref, case when ref is null then null when starts_with(ref, 'http') then ref when starts_with(ref, '/') then regexp_extract(url, '^[a-z]+://[^/]*') || ref
 else regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', ''), '^([a-z]+://[^/]*/(?:.*/)?)[^/]+/$', '\\1') || 'assets/up.css' end as asset_url from r),
s as (select *, case when asset_url is null then null when contains(asset_url, '/assets/lib') then 404 when contains(asset_url, 'up.css') then null else 200 end as status from f)
select page_id, ref, asset_url, status, case when ref is null then 'no_assets' when status between 200 and 299 then 'ok' else 'failed' end as verdict from s""",
)
def _(spark, d):
    extra = F.expr(
        "case page_id % 3 when 0 then '<script async src=\\'https://cdn.example/assets/lib.js#x\\'></script><script src=\"data:text/js,1\"></script>' "
        "when 1 then '<link rel=x href=\"../assets/up.css\"><script src=\"/assets/a.js\"></script>' else '<script src=\"/static/c.js\"></script>' end"
    )
    bare = table(spark, d, "pages").filter("page_id % 4 = 0").select("page_id", "url", "html")
    pages = derive(spark, d, "dirty_pages").filter("page_id % 4 <> 0").withColumn("html", F.replace("html", F.lit("</footer>"), extra)).unionByName(bare)
    refs = html.asset_refs(pages)
    fetched = refs.filter("asset_url is not null").select("asset_url").distinct().select(
        "asset_url",
        F.when(F.contains("asset_url", F.lit("/assets/lib")), 404).when(~F.contains("asset_url", F.lit("up.css")), 200).alias("status"),
    )
    return html.check_assets(refs, fetched)
