"""Ingest and crawl guards: file routing, address blocking, fetch verdicts, redirects, article checks."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import net
from lectern.functions import text as T
from lectern.functions.plan import let
from lectern.operators.html import resolve_url
from lectern.policies import FETCH_TIMEOUT_MS, MAX_REDIRECTS, MAX_RESPONSE_BYTES
from lectern.session import written

MARKDOWN_NAME = r"(?i)\.md(?:own|arkdown)?\z"
HTML_NAME = r"(?i)\.html?\z"
CONTROL = r"[\x00-\x08\x0E-\x1F\x7F]"

# Messages shown with each code.
MESSAGES = {
    "BINARY_FILE_CONTENT": "Uploaded file appears to be binary or contains unsupported control characters.",
    "MALFORMED_URL": "Malformed URL.",
    "BAD_SCHEME": "Only http/https URLs are allowed.",
    "BLOCKED_HOST": "Target host resolves to a blocked IP range.",
    "NO_RECORDS": "Hostname resolved with no records.",
    "UNRESOLVED": "Unable to resolve hostname.",
    "NO_LOCATION": "Redirect response is missing location header.",
    "TOO_MANY_REDIRECTS": "Maximum redirects exceeded.",
    "NOT_HTML": "Response is not HTML content.",
    "FETCH_FAILED": "Fetch failed.",
    "NO_CONTENT": "Unable to extract readable content.",
}


def file_route(name: Column, mime: Column) -> Column:
    """html, markdown, text or UNSUPPORTED_FILE_TYPE. Markdown is judged by name, HTML by name or type."""
    kind = F.coalesce(mime, F.lit(""))
    html = name.rlike(HTML_NAME) | F.startswith(F.lower(kind), F.lit("text/html"))
    plain = (kind == "") | F.startswith(kind, F.lit("text/")) | kind.isin("application/json", "application/xml")
    return (
        F.when(html, "html")
        .when(name.rlike(MARKDOWN_NAME), "markdown")
        .when(plain, "text")
        .otherwise("UNSUPPORTED_FILE_TYPE")
    )


def classify_file(files: DataFrame, name: str = "name", mime: str = "mime") -> DataFrame:
    return files.withColumn("route", file_route(F.col(name), F.col(mime)))


def looks_binary(raw: Column) -> Column:
    return (T.js_trim(raw) == "") | raw.rlike(CONTROL)


def quarantine_binary(files: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Readable rows, and rejected rows with their code and message."""
    flagged = F.coalesce(looks_binary(F.col(raw)), F.lit(True))
    rejects = files.filter(flagged).drop(raw)
    return files.filter(~flagged), rejects.select(
        "*",
        F.lit("BINARY_FILE_CONTENT").alias("error_code"),
        F.lit(MESSAGES["BINARY_FILE_CONTENT"]).alias("error_message"),
    )


def url_error(url: Column) -> Column:
    """Null for an http/https address, else the reason."""
    protocol = net.url_protocol(url)
    host = F.try_parse_url(url, F.lit("HOST"))
    return (
        F.when(protocol.isNull(), MESSAGES["MALFORMED_URL"])
        .when(~protocol.isin("http", "https"), MESSAGES["BAD_SCHEME"])
        .when(host.isNull() | (host == ""), MESSAGES["MALFORMED_URL"])
    )


def guard_url(df: DataFrame, url: str = "url") -> DataFrame:
    reason = url_error(F.col(url))
    return df.withColumn("error_code", F.when(reason.isNotNull(), "INVALID_URL")).withColumn("error_message", reason)


# Address ranges that may not be fetched.
BLOCKED_CIDRS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "::1/128", "::/128", "fe80::/10", "fc00::/7",
)


def cidr_ranges(spark: SparkSession, cidrs: tuple[str, ...] = BLOCKED_CIDRS) -> DataFrame:
    """(version, octet, ranges): per leading octet the address ranges under it, as sortable hex keys.

    Splitting by octet turns the range test into an equi-join with a short list to scan, instead of a nested loop.
    """
    found: dict[tuple[int, str], list[tuple[str, str]]] = {}
    for cidr in cidrs:
        network = ipaddress.ip_network(cidr)
        width = 8 if network.version == 4 else 32
        lo, hi = (f"{int(a):0{width}x}" for a in (network.network_address, network.broadcast_address))
        for octet in range(int(lo[:2], 16), int(hi[:2], 16) + 1):
            found.setdefault((network.version, f"{octet:02x}"), []).append((lo, hi))
    spans = lambda ranges: ", ".join(f"named_struct('lo', '{lo}', 'hi', '{hi}')" for lo, hi in ranges)
    rows = ", ".join(f"({version}, '{octet}', array({spans(ranges)}))" for (version, octet), ranges in found.items())
    return spark.sql(f"select * from values {rows} as t(version, octet, ranges)")


def flag_blocked(df: DataFrame, cidr: DataFrame, address: str = "address") -> DataFrame:
    """Adds `blocked`. A trailing dotted quad decides for mixed addresses; text that is no address is blocked."""
    value = F.col(address)
    quad = net.ipv4_to_long(net.trailing_ipv4(value))
    key = let(quad, lambda q: F.when(q.isNotNull(), F.lower(F.lpad(F.hex(q), 8, "0"))).otherwise(net.ipv6_to_hex(value)))
    keyed = df.withColumn("_key", key).withColumn("_v", F.when(F.length("_key") == 8, 4).when(F.length("_key") == 32, 6))
    # A few address families hold most rows, so this join must not shuffle on the octet. Two versions of 256 octets make
    # 512 rows at most.
    ranges = F.broadcast(cidr.select(F.col("version").alias("_v"), F.col("octet").alias("_octet"), "ranges"))
    joined = keyed.withColumn("_octet", F.left("_key", F.lit(2))).join(ranges, ["_v", "_octet"], "left")
    inside = F.exists(
        F.coalesce("ranges", F.array().cast("array<struct<lo:string,hi:string>>")),
        lambda r: F.col("_key").between(r["lo"], r["hi"]),
    )
    return joined.withColumn("blocked", F.col("_key").isNull() | inside).drop("_key", "_v", "_octet", "ranges")


def block_private_hosts(addresses: DataFrame, cidr: DataFrame, address: str = "address") -> DataFrame:
    """Only the rows whose address may not be fetched."""
    return flag_blocked(addresses, cidr, address).filter("blocked").drop("blocked")


def host_verdict(hosts: DataFrame, dns: DataFrame, cidr: DataFrame, host: str = "host") -> DataFrame:
    """Adds `error_code` and `error_message`; null when the host may be fetched.

    `dns(host, address)` is reduced to one row per host before the join, so a host with very many records or very many
    pages stays cheap. A host without any row could not be looked up; one whose only rows have a null address was found
    to have no records. Address literals are judged in place and never looked up.
    """
    resolved = (
        flag_blocked(dns.select(F.col("host").alias(host), "address"), cidr)
        .groupBy(host)
        .agg(F.bool_or(F.when(F.col("address").isNotNull(), F.col("blocked"))).alias("_any_blocked"), F.lit(True).alias("_found"))
    )
    literal = net.is_ipv4(F.col(host)) | net.ipv6_to_hex(F.col(host)).isNotNull()
    judged = flag_blocked(hosts.withColumn("_literal", literal), cidr, host).join(resolved, host, "left")
    bad = F.when(F.col("_literal"), F.col("blocked")).otherwise(F.coalesce("_any_blocked", F.lit(False)))
    silent = ~F.col("_literal") & F.col("_any_blocked").isNull()
    message = F.when(F.col("_found"), MESSAGES["NO_RECORDS"]).otherwise(MESSAGES["UNRESOLVED"])
    return (
        judged.withColumn("error_code", F.when(bad, "BLOCKED_HOST").when(silent, "UNREADABLE_CONTENT"))
        .withColumn("error_message", F.when(bad, MESSAGES["BLOCKED_HOST"]).when(silent, message))
        .drop("_literal", "_any_blocked", "_found", "blocked")
    )


def fetch_verdict(status: Column, location: Column, content_type: Column, n_bytes: Column,
                  failure: Column | None = None) -> Column:
    """Struct(verdict, error_code, error_message) of one response, in the order the checks are made."""
    failure = F.lit(None).cast("string") if failure is None else failure

    def made(verdict: str, code: str | None = None, message: Column | str | None = None) -> Column:
        message = message if isinstance(message, Column) else F.lit(message).cast("string")
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(code).cast("string").alias("error_code"), message.alias("error_message"))

    unreadable = "UNREADABLE_CONTENT"
    redirect = (status >= 300) & (status < 400)
    origin = F.concat(F.lit("Origin responded with status "), status.cast("string"), F.lit("."))
    return (
        F.when(failure == "timeout", made("error", "FETCH_TIMEOUT", f"Request timed out after {FETCH_TIMEOUT_MS}ms."))
        .when(failure.isNotNull() | status.isNull(), made("error", unreadable, MESSAGES["FETCH_FAILED"]))
        .when(redirect & (F.coalesce(location, F.lit("")) == ""), made("error", unreadable, MESSAGES["NO_LOCATION"]))
        .when(redirect, made("redirect"))
        .when((status < 200) | (status >= 300), made("error", unreadable, origin))
        .when(~F.contains(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("text/html")), made("error", unreadable, MESSAGES["NOT_HTML"]))
        .when(n_bytes > MAX_RESPONSE_BYTES, made("error", unreadable, f"Response exceeded {MAX_RESPONSE_BYTES} bytes."))
        .otherwise(made("ok"))
    )


def classify_fetch(crawl: DataFrame) -> DataFrame:
    """Adds verdict, error_code and error_message to crawl-log rows."""
    failure = F.col("failure") if "failure" in crawl.columns else None
    verdict = fetch_verdict(F.col("status"), F.col("location"), F.col("content_type"), F.col("n_bytes"), failure)
    return crawl.withColumn("_f", verdict).select(*crawl.columns, "_f.*")


def judged_hosts(responses: DataFrame, dns: DataFrame, cidr: DataFrame, *columns: str, folder: str | None = None) -> DataFrame:
    """Adds `<column>_code` and `<column>_message` for the hosts of address columns; null when they may be fetched.

    Every distinct host is judged once; the verdicts are unique per host, so a host with most of the rows only repeats
    the side that adaptive execution can split. With a shared `folder` they are written there, as every column reads them.
    """
    hosts = responses.select(F.explode(F.array(*[net.url_host(F.col(c)) for c in columns])).alias("host")).filter("host is not null").distinct()
    verdicts = written(host_verdict(hosts, dns, cidr).filter("error_code is not null"), folder and f"{folder}/hosts")
    out = responses
    for c in columns:
        known = verdicts.select(F.col("host").alias("_host"), F.col("error_code").alias(f"{c}_code"), F.col("error_message").alias(f"{c}_message"))
        out = out.withColumn("_host", net.url_host(F.col(c))).join(known, "_host", "left").drop("_host")
    return out


def resolve_redirects(
    crawl: DataFrame, max_redirects: int = MAX_REDIRECTS, dns: DataFrame | None = None, cidr: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Every crawled address followed to its end: (url, final_url, hops, verdict, error_code, error_message).

    `crawl` has one row per address. With `dns(host, address)` and address ranges, the host of the first address and of
    every hop is judged before it counts as fetched, and a walk that meets a forbidden one ends there. Responses that
    are no redirect need no walk at all. Redirects take one step by a join with the log; steps are then joined with
    themselves, so each round doubles how far a redirect sees, and only walks that are still going take part. Many
    redirects to one address (a login page) share a key; the other side is unique, so adaptive execution splits them.
    With a shared `folder` the judged log and the first steps are written there and computed once; later rounds read only
    what is still going.
    """
    ends = ("verdict", "error_code", "error_message")
    judged = classify_fetch(crawl).withColumn(
        "target", F.when(F.col("verdict") == "redirect", resolve_url(F.col("url"), F.col("location")))
    )
    problem = F.when(F.col("target").isNotNull(), url_error(F.col("target")))
    judged = judged.select("url", "target", problem.alias("target_error"), F.when(problem.isNotNull(), "INVALID_URL").alias("target_code"), *ends)
    if dns is not None:
        hosts = judged_hosts(judged.withColumnRenamed("target_code", "_code").withColumnRenamed("target_error", "_error"), dns, cidr, "url", "target", folder=folder)
        closed = F.col("url_code").isNotNull()
        judged = hosts.select(
            "url",
            F.when(~closed, F.col("target")).alias("target"),
            F.coalesce("_error", "target_message").alias("target_error"),
            F.coalesce("_code", "target_code").alias("target_code"),
            F.when(closed, "error").otherwise(F.col("verdict")).alias("verdict"),
            F.when(closed, F.col("url_code")).otherwise(F.col("error_code")).alias("error_code"),
            F.when(closed, F.col("url_message")).otherwise(F.col("error_message")).alias("error_message"),
        )
    judged = written(judged, folder and f"{folder}/log")
    straight = judged.filter("verdict <> 'redirect'").select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), *ends)

    # One step of every redirect; `going` where it leads to another one.
    redirects = judged.filter("verdict = 'redirect'").select("url", "target", "target_error", "target_code")
    unreadable = "UNREADABLE_CONTENT"
    log = judged.select(F.col("url").alias("target"), *ends)
    met = redirects.filter("target_error is null").join(log, "target", "left")
    lost = F.col("verdict").isNull()
    met = met.select(
        "url", F.col("target").alias("final_url"), F.lit(1).alias("hops"), (F.coalesce("verdict", F.lit("")) == "redirect").alias("going"),
        F.when(lost, "error").otherwise(F.col("verdict")).alias("verdict"),
        F.when(lost, unreadable).otherwise(F.col("error_code")).alias("error_code"),
        F.when(lost, MESSAGES["FETCH_FAILED"]).otherwise(F.col("error_message")).alias("error_message"),
    )
    invalid = redirects.filter("target_error is not null").select(
        "url", F.col("target").alias("final_url"), F.lit(1).alias("hops"), F.lit(False).alias("going"),
        F.lit("error").alias("verdict"), F.col("target_code").alias("error_code"), F.col("target_error").alias("error_message"),
    )
    steps = written(met.unionByName(invalid), folder and f"{folder}/steps-1")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        """The steps of `first`, and where they have not ended, those of `second` from there."""
        far = second.select(F.col("url").alias("final_url"), F.col("final_url").alias("_to"), F.col("hops").alias("_more"), *[F.col(c).alias(f"_{c}") for c in ("going", *ends)])
        further = first.filter("going").select("url", "final_url", "hops").join(far, "final_url")
        further = further.select("url", F.col("_to").alias("final_url"), (F.col("hops") + F.col("_more")).alias("hops"), *[F.col(f"_{c}").alias(c) for c in ("going", *ends)])
        return first.filter("not going").unionByName(further)

    walk, power, left = None, steps, max_redirects
    while left:
        if left & 1:
            walk = power if walk is None else then(walk, power)
        left >>= 1
        if left:
            power = then(power, power)
    if walk is None:
        walk = redirects.select("url", F.col("url").alias("final_url"), F.lit(0).alias("hops"), F.lit(True).alias("going"), *[F.lit(None).cast("string").alias(c) for c in ends])
    over = lambda c, value: F.when(F.col("going"), value).otherwise(F.col(c)).alias(c)
    walk = walk.select("url", "final_url", "hops", over("verdict", "error"), over("error_code", unreadable), over("error_message", MESSAGES["TOO_MANY_REDIRECTS"]))
    return straight.unionByName(walk)


def validate_article(articles: DataFrame) -> DataFrame:
    """Trims the text and adds `error_code`: title and text are required, optional fields may not be blank strings."""
    text = T.js_trim(F.col("text_content"))
    optional = [F.coalesce(F.length(F.col(c)) > 0, F.lit(True)) for c in ("byline", "excerpt", "site_name")]
    fields_ok = optional[0] & optional[1] & optional[2]
    present = (F.coalesce(F.col("title"), F.lit("")) != "") & (F.coalesce(text, F.lit("")) != "")
    return (
        articles.withColumn("text_content", text)
        .withColumn("error_code", F.when(~present, "UNREADABLE_CONTENT").when(~fields_ok, "INVALID_URL"))
        .withColumn("error_message", F.when(~present, MESSAGES["NO_CONTENT"]).when(
            ~fields_ok, "Request body must contain a valid http/https URL."))
    )


def map_error_status(df: DataFrame) -> DataFrame:
    """Server status of an extraction error, and the client's code for a response status (null: no response).

    Reads `error_code` (null is success, `BAD_BODY` an unparsable request) and `responded`.
    """
    code = F.col("error_code")
    status = (
        F.when(code.isNull(), 200)
        .when(code == "BAD_BODY", 400)
        .when(code == "FETCH_TIMEOUT", 504)
        .otherwise(422)
    )
    client = (
        F.when(~F.col("responded"), "URL_EXTRACT_UNAVAILABLE")
        .when((F.col("status") == 404) | (F.col("status") >= 500), "URL_EXTRACT_UNAVAILABLE")
        .when((F.col("status") < 200) | (F.col("status") >= 300), "URL_EXTRACT_FAILED")
    )
    return df.withColumn("status", F.when(F.col("responded"), status)).withColumn("client_code", client)
