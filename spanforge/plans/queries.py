"""Queries over whole tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import compile, escape, escape_column, presets
from ..operators import intervals, literals, matches, summaries
from ..sources import read_table
from ..streaming.chunks import match_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _counted(spark, sf_dir, table, key, text, pattern, name="n"):
    p = compile(pattern)
    return read_table(spark, sf_dir, table).select(key, p.count(F.col(text)).cast("long").alias(name))


def _count_sql(table: str, key: str, text: str, pattern: str) -> str:
    return f"SELECT {key}, len(regexp_extract_all({text}, '{pattern}')) AS n FROM {table}"


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9A-Za-z][0-9A-Za-z_.+%-]*@(?:[0-9A-Za-z-]+\\.){1,8}[A-Za-z]{2,}')")
def is_match_email(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where(compile(presets.EMAIL).is_match(F.col("text"))).select("doc_id")


@query("SELECT doc_id FROM documents WHERE contains(text, 'License')")
def is_match_literal(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").where(compile("License").is_match(F.col("text"))).select("doc_id")


@query("SELECT c_custkey FROM customer WHERE c_name = 'Customer#000000007' OR ends_with(c_name, '99') OR starts_with(c_name, 'Customer#00000001')")
def literal_anchors(spark, sf_dir):
    name = F.col("c_name")
    found = compile(r"\ACustomer\#000000007\z").is_match(name) | compile(r"99\z").is_match(name) | compile(r"\ACustomer\#00000001").is_match(name)
    return read_table(spark, sf_dir, "customer").where(found).select("c_custkey")


@query("SELECT page_id, nullif(regexp_extract(html, 'https?://[0-9A-Za-z.-]+(?::[0-9]{1,5})?(?:/[^\\s<>\"'']*)?', 0), '') AS url FROM pages")
def find_first_url(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", compile(presets.URL).find_text(F.col("html")).alias("url"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM conversations) GROUP BY token")
def find_all_words(spark, sf_dir):
    return matches.token_counts(read_table(spark, sf_dir, "conversations"), "text", compile("[A-Za-z]+"))


@query(_count_sql("documents", "doc_id", "text", "\\bthe\\b"))
def count_the(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"\bthe\b")


@query("SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(event_type, 'error|signup|purchase') GROUP BY event_type")
def keyword_alternation(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").where(compile("error|signup|purchase").is_match(F.col("event_type")))
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, nullif(regexp_extract(url, '(\\w+)://([^/]+)', 1), '') AS scheme, nullif(regexp_extract(url, '(\\w+)://([^/]+)', 2), '') AS host FROM pages")
def capture_named_url(spark, sf_dir):
    found = compile(r"(?P<scheme>\w+)://(?P<host>[^/]+)").captures(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", found.alias("c")).select("page_id", "c.scheme", "c.host")


@query("SELECT page_id, unnest(regexp_extract_all(html, '(\\w+)=\"([^\"]*)\"', 1)) AS name, unnest(regexp_extract_all(html, '(\\w+)=\"([^\"]*)\"', 2)) AS value FROM pages")
def captures_iter_attrs(spark, sf_dir):
    found = matches.capture_table(read_table(spark, sf_dir, "pages"), ["page_id"], "html", compile(r'(?<name>\w+)="(?<value>[^"]*)"'))
    return found.select("page_id", "name", "value")


@query("SELECT page_id, regexp_replace(html, '</?[A-Za-z!][^<>]*>', '', 'g') AS plain FROM pages")
def strip_tags(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", compile(presets.TAG).replace_all(F.col("html"), "").alias("plain"))


@query("SELECT c_custkey, regexp_replace(c_name, '\\d+', '$1\\\\') AS name FROM customer")
def replace_first_digits(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", compile(r"\d+").replace(F.col("c_name"), "$1\\").alias("name"))


@query("SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '\"k\": (\\d+)', 1), '') AS INTEGER) AS k FROM events")
def json_value(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", compile(r'"k": (?<k>\d+)').captures(F.col("props"))["k"].cast("int").alias("k"))


@query(_count_sql("pages", "page_id", "html", '"(?:[^"\\\\]|\\\\.)*"'))
def json_strings(spark, sf_dir):
    return _counted(spark, sf_dir, "pages", "page_id", "html", presets.JSON_STRING)


@query(_count_sql("documents", "doc_id", "text", "(?m)^[A-Z]\\w*"))
def multiline_heads(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?m)^[A-Z]\w*")


@query(_count_sql("documents", "doc_id", "text", "(?m)[a-z]\\.$"))
def multiline_tails(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?m)[a-z]\.$")


@query(_count_sql("documents", "doc_id", "text", "(?i)\\band\\b"))
def case_insensitive(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?i)\band\b")


@query(_count_sql("documents", "doc_id", "text", "(?i)étre|ê"))
def case_insensitive_accents(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?i)Étre|ê")


@query(_count_sql("documents", "doc_id", "text", "\\p{L}+"))
def unicode_letters(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"\p{L}+")


@query(_count_sql("documents", "doc_id", "text", "[b-df-hj-np-tv-z]{3,}"))
def class_set_ops(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"[a-z&&[^aeiou]]{3,}")


@query(_count_sql("documents", "doc_id", "text", "[b-df-hj-np-tv-z]{2}[aeiou]"))
def class_difference(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"[a-z--[aeiou]]{2}[a-z~~[b-df-hj-np-tv-z]]")


@query(_count_sql("documents", "doc_id", "text", "[[:upper:]][[:lower:]]+"))
def posix_class(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"[[:upper:]][[:lower:]]+")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(\\w+)ing\\b', 1)) AS token FROM documents) GROUP BY token")
def lookahead_ing(spark, sf_dir):
    return matches.token_counts(read_table(spark, sf_dir, "documents"), "text", compile(r"\w+(?=ing\b)"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '@(\\w+)', 1)) AS token FROM documents")
def lookbehind_at(spark, sf_dir):
    return matches.tokenize(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", compile(r"(?<=@)\w+")).select("doc_id", "token")


@query("""SELECT page_id, len(regexp_extract_all(html, '''[^''"]*''|"[^''"]*"')) AS n FROM pages""")
def backref_quotes(spark, sf_dir):
    return _counted(spark, sf_dir, "pages", "page_id", "html", r"""(['"])[^'"]*\1""")


@query("""
    WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '([^A-Za-z]*)([A-Za-z]+)', 1) AS g, regexp_extract_all(text, '([^A-Za-z]*)([A-Za-z]+)', 2) AS w FROM conversations),
    r AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(g) AS g, unnest(w) AS w FROM p),
    s AS (SELECT *, sum(strlen(g) + strlen(w)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM r)
    SELECT conv_id, turn, i AS match_no, CAST(e - strlen(w) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", w AS text FROM s""")
def match_spans(spark, sf_dir):
    found = matches.match_table(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", compile("[A-Za-z]+"))
    return found.withColumn("match_no", F.col("match_no").cast("long"))


@query("""
    WITH p AS (SELECT doc_id, regexp_extract(text, '\\p{Lu}\\p{Ll}+', 0) AS t, strlen(regexp_extract(text, '^(?s:(.*?))\\p{Lu}\\p{Ll}+', 1)) AS s FROM documents)
    SELECT doc_id, CASE WHEN t <> '' THEN s END AS "start", CASE WHEN t <> '' THEN s + strlen(t) END AS "end", nullif(t, '') AS text FROM p""")
def find_first_span(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", compile(r"\p{Lu}\p{Ll}+").find(F.col("text")).alias("m"))
    return docs.select("doc_id", F.col("m.start").cast("long").alias("start"), F.col("m.end").cast("long").alias("end"), "m.text")


@query("SELECT event_id, len(list_filter(regexp_extract_all(props, '(\\d)(\\d)?', 2), lambda x: x IS NOT NULL AND x <> '')) AS seconds, len(regexp_extract_all(props, '(\\d)(\\d)?')) AS n FROM events")
def optional_group_null(spark, sf_dir):
    found = compile(r"(\d)(?<second>\d)?").captures_all(F.col("props"))
    events = read_table(spark, sf_dir, "events").select("event_id", found.alias("f"))
    return events.select("event_id", F.size(F.filter("f", lambda x: x["second"].isNotNull())).cast("long").alias("seconds"), F.size("f").cast("long").alias("n"))


@query("SELECT page_id FROM pages WHERE contains(url, '.example/') OR contains(url, '?') OR contains(url, 'page')")
def escape_literal(spark, sf_dir):
    url = F.col("url")
    return read_table(spark, sf_dir, "pages").where(compile(escape(".example/")).is_match(url) | compile(escape("?")).is_match(url) | compile(escape("page")).is_match(url)).select("page_id")


@query(r"SELECT page_id, regexp_replace(url, '([\\.*+?|^$()\[\]{}#])', '\\\1', 'g') AS escaped FROM pages")
def escape_urls(spark, sf_dir):
    return read_table(spark, sf_dir, "pages").select("page_id", escape_column(F.col("url")).alias("escaped"))


@query(_count_sql("pages", "page_id", "html", "<p>.*?</p>"))
def lazy_quantifier(spark, sf_dir):
    return _counted(spark, sf_dir, "pages", "page_id", "html", r"<p>.*?</p>")


@query(_count_sql("documents", "doc_id", "text", "(?:[a-z]+ ){3}[a-z]+"))
def bounded_repeats(spark, sf_dir):
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?:[a-z]+ ){3}[a-z]+")


@query(_count_sql("documents", "doc_id", "text", "(?:[a-z]+ )+[a-z]+"))
def possessive_loop(spark, sf_dir):
    """A loop over a group that gives iterations back, in texts of any length: it would deepen the JVM's stack, so it runs
    outside (explain() says: deep loop)."""
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"(?:[a-z]+ )+[a-z]+")


@query("SELECT doc_id, len(regexp_extract_all(text, '(?i)the|and|of')) AS n FROM documents WHERE NOT regexp_matches(text, '[0-9]{5}')")
def anti_filter(spark, sf_dir):
    text = F.col("text")
    docs = read_table(spark, sf_dir, "documents").where(~compile(r"\d{5}").is_match(text))
    return docs.select("doc_id", compile("(?i)the|and|of").count(text).cast("long").alias("n"))


@query("SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b(?:the|and|of|que|les|der)\\b')) AS word FROM documents) GROUP BY doc_id, word")
def dictionary(spark, sf_dir):
    return matches.dictionary_matches(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", ["the", "and", "of", "que", "les", "der"])


@query("SELECT page_id FROM pages p WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(p.html, split_part(b.text, ' ', 1) || ' ' || split_part(b.text, ' ', 2)))")
def literal_semi_join(spark, sf_dir):
    """Pages that hold the first two words of a benchmark text."""
    heads = read_table(spark, sf_dir, "benchmark").select(F.substring_index("text", " ", 2).alias("head"))
    return literals.literal_semi_join(read_table(spark, sf_dir, "pages"), "html", heads, "head").select("page_id")


@query("""
    WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS word FROM benchmark),
    t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[0-9A-Za-z_]+')) AS word FROM conversations)
    SELECT conv_id, turn, word AS text, count(*) AS n FROM t WHERE word IN (SELECT word FROM w) GROUP BY ALL""")
def dictionary_join(spark, sf_dir):
    """All words of the benchmark, a dictionary that grows with its table, in all conversations."""
    words = matches.tokenize(read_table(spark, sf_dir, "benchmark"), ["item_id"], "text", compile("[0-9A-Za-z_]+")).select("token")
    found = literals.dictionary_join(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", words, "token")
    return found.groupBy("conv_id", "turn", "text").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
    WITH h AS (SELECT nullif(regexp_extract(url, '(\w+)://([^/]+)', 1), '') AS scheme, nullif(regexp_extract(url, '(\w+)://([^/]+)', 2), '') AS host FROM pages)
    SELECT scheme, host, count(*) AS n FROM h GROUP BY ROLLUP (scheme, host)""")
def host_rollup(spark, sf_dir):
    found = compile(r"(?P<scheme>\w+)://(?P<host>[^/]+)").captures(F.col("url"))
    pages = read_table(spark, sf_dir, "pages").select(found.alias("c")).select("c.scheme", "c.host")
    return pages.rollup("scheme", "host").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(\\w+)="(\\w)', 1)) AS name, unnest(regexp_extract_all(html, '(\\w+)="(\\w)', 2)) AS first FROM pages),
    s AS (SELECT name, first, count(*) AS matches, count(DISTINCT page_id) AS texts FROM m GROUP BY ALL)
    SELECT name, first, CAST(grouping(name) * 2 + grouping(first) AS BIGINT) AS level, CAST(sum(matches) AS BIGINT) AS matches, CAST(sum(texts) AS BIGINT) AS texts FROM s GROUP BY CUBE (name, first)""")
def attribute_cube(spark, sf_dir):
    """Attributes by name and first character of the value, over all grouping sets, from a summary that merges."""
    pages = read_table(spark, sf_dir, "pages")
    summary = summaries.match_summary(pages, "html", compile(r'(?<name>\w+)="(?<first>\w)'), ["name", "first"])
    return summaries.rolled_up(summary).drop("distinct")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE regexp_matches(event_type, 'error|purchase') GROUP BY 1")
def daily_event_matches(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").where(compile("error|purchase").is_match(F.col("event_type")))
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT line, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^\\n]+')) AS line FROM documents) GROUP BY line HAVING count(DISTINCT doc_id) > 1")
def dup_lines(spark, sf_dir):
    lines = matches.tokenize(read_table(spark, sf_dir, "documents"), ["doc_id"], "text", compile(r"[^\n]+"))
    return lines.select(F.col("token").alias("line"), "doc_id").distinct().groupBy("line").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1")


@query("""
    WITH m AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z]+') AS w FROM conversations))
    SELECT conv_id, turn, i AS position, word, lag(word) OVER (PARTITION BY conv_id, turn ORDER BY i) AS before FROM m""")
def word_pairs(spark, sf_dir):
    words = matches.tokenize(read_table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text", compile("[A-Za-z]+"))
    before = F.lag("token").over(Window.partitionBy("conv_id", "turn").orderBy("position"))
    return words.select("conv_id", "turn", (F.col("position") + 1).cast("long").alias("position"), F.col("token").alias("word"), before.alias("before"))


@query("SELECT event_id, regexp_matches(event_type, '^(?:[a-z]+_)*[a-z]+$') AS snake FROM events")
def anchored_loop(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", compile(r"^(?:[a-z]+_)*[a-z]+$").is_match(F.col("event_type")).alias("snake"))


@query("SELECT conv_id, turn, regexp_replace(text, '(?:a|ab)+c', '#', 'g') AS t FROM conversations")
def replace_outside(spark, sf_dir):
    """A loop whose branches overlap runs outside the JVM."""
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", compile("(?:a|ab)+c").replace_all(F.col("text"), "#").alias("t"))


@query("SELECT conv_id, turn, length_grapheme(text) AS n FROM conversations")
def grapheme_clusters(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", compile(r"\X").count(F.col("text")).cast("long").alias("n"))


@query("""
    WITH p AS (SELECT conv_id, turn, regexp_extract(text, '(?:a|an)+d', 0) AS t, strlen(regexp_extract(text, '^(?s:(.*?))(?:a|an)+d', 1)) AS s FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN t <> '' THEN s END AS INTEGER) AS "start", CAST(CASE WHEN t <> '' THEN s + strlen(t) END AS INTEGER) AS "end", CAST(NULL AS VARCHAR) AS error FROM p""")
def try_find_overlap(spark, sf_dir):
    found = compile(r"(?:a|an)+d", seconds=5.0).try_find(F.col("text"))
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("f")).select("conv_id", "turn", "f.value.start", "f.value.end", "f.error")


@query("""
    WITH p AS (SELECT conv_id, turn, regexp_matches(text, '[A-Z][a-z]+ [a-z]+') AS m, strlen(regexp_extract(text, '^(?s:(.*?))[A-Z][a-z]+ [a-z]+', 1)) AS s, strlen(regexp_extract(text, '[A-Z][a-z]+ [a-z]+', 0)) AS n FROM conversations)
    SELECT conv_id, turn, CAST(CASE WHEN m THEN s END AS INTEGER) AS first_start, CAST(CASE WHEN m THEN s + n END AS INTEGER) AS then_end FROM p""")
def capture_spans(spark, sf_dir):
    found = compile(r"(?<first>[A-Z][a-z]+) (?<then>[a-z]+)").captures(F.col("text"), spans=True)
    docs = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", found.alias("c"))
    return docs.select("conv_id", "turn", F.col("c.first.start").alias("first_start"), F.col("c.then.end").alias("then_end"))


def _runs_sql(name: str, table: str, keys: str, text: str, inside: str) -> str:
    """A common table of the runs of a class of characters: keys, i, s, e (bytes), t."""
    other = f"([^{inside}]*)([{inside}]+)"
    return f"""{name}p AS (SELECT {keys}, regexp_extract_all({text}, '{other}', 1) AS g, regexp_extract_all({text}, '{other}', 2) AS w FROM {table}),
    {name}r AS (SELECT {keys}, CAST(unnest(range(1, len(w) + 1)) AS INTEGER) AS i, unnest(g) AS g, unnest(w) AS t FROM {name}p),
    {name} AS (SELECT {keys}, i, t, CAST(sum(strlen(g) + strlen(t)) OVER (PARTITION BY {keys} ORDER BY i) AS INTEGER) AS e, e - strlen(t) AS s FROM {name}r)"""


_HEADS = f"WITH {_runs_sql('a', 'pages', 'page_id', 'html', 'A-Z')}, {_runs_sql('b', 'pages', 'page_id', 'html', '0-9')}"


@query(f"""{_HEADS}
    SELECT a.page_id, a.i AS a_match_no, CAST(a.s AS INTEGER) AS a_start, a.e AS a_end, a.t AS a_text, b.i AS b_match_no, CAST(b.s AS INTEGER) AS b_start, b.e AS b_end, b.t AS b_text,
           CAST(greatest(b.s - a.e, a.s - b.e) AS BIGINT) AS gap
    FROM a JOIN b ON a.page_id = b.page_id AND greatest(b.s - a.e, a.s - b.e) <= 12""")
def near_matches(spark, sf_dir):
    return intervals.near_matches(read_table(spark, sf_dir, "pages"), ["page_id"], "html", compile("[A-Z]+"), compile("[0-9]+"), 12)


@query(f"""{_HEADS}
    SELECT b.page_id, b.i AS match_no, CAST(b.s AS INTEGER) AS "start", b.e AS "end", b.t AS text, a.i AS mark_no, CAST(a.s AS INTEGER) AS mark_start, a.e AS mark_end, a.t AS mark
    FROM b ASOF LEFT JOIN a ON b.page_id = a.page_id AND b.s >= a.e""")
def last_before(spark, sf_dir):
    return intervals.last_before(read_table(spark, sf_dir, "pages"), ["page_id"], "html", compile("[A-Z]+"), compile("[0-9]+"))


@query("""
    SELECT p.event_id, e.event_id AS error_id, CAST(epoch_us(p.ts) - epoch_us(e.ts) AS BIGINT) AS micros
    FROM events p LEFT JOIN events e ON p.user_id = e.user_id AND e.ts <= p.ts AND epoch_us(p.ts) - epoch_us(e.ts) <= 864000000000 AND regexp_matches(e.event_type, 'error|signup')
    WHERE regexp_matches(p.event_type, 'purchase') QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY e.ts DESC NULLS LAST, e.event_id DESC) = 1""")
def asof_events(spark, sf_dir):
    """Each purchase with the same user's last error or signup of the ten days before it."""
    events, kind = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), F.col("event_type")
    found = intervals.asof_join(events.where(compile("purchase").is_match(kind)), events.where(compile("error|signup").is_match(kind)), ["user_id"], "ts", "ts", width=86400, ties=["event_id"], within=864000)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("event_id", F.col("found.event_id").alias("error_id"), (micros("ts") - micros("found.ts")).alias("micros"))


@query("""
    WITH h AS (SELECT user_id, ts FROM events WHERE regexp_matches(event_type, 'error|purchase')),
    g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 90 HOUR THEN 0 ELSE 1 END AS new FROM h),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS last, count(*) AS rows, count(*) AS matches FROM s GROUP BY user_id, k""")
def session_matches(spark, sf_dir):
    """Sessions of a user's errors and purchases, less than 90 hours apart."""
    found = match_sessions(read_table(spark, sf_dir, "events"), "ts", ["user_id"], "event_type", compile("error|purchase"), "90 hours")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("user_id", micros("session_start").alias("first"), (micros("session_end") - 90 * 3_600_000_000).alias("last"), "rows", "matches")


@query(_count_sql("documents", "doc_id", "text", "\\d+\\.\\d"))
def version_pairs(spark, sf_dir):
    """A match may start inside the run of digits that the match before it ended in."""
    return _counted(spark, sf_dir, "documents", "doc_id", "text", r"\d+\.\d")


@query()
def token_counts_bpe(spark, sf_dir):
    """How a public tokenizer's pattern splits all documents, counted."""
    return matches.token_counts(read_table(spark, sf_dir, "documents"), "text", compile(presets.BYTE_PAIR_100K))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(d.text, b.text))")
def benchmark_semi_join(spark, sf_dir):
    """Documents that hold a benchmark passage as it is."""
    return literals.literal_semi_join(read_table(spark, sf_dir, "documents"), "text", read_table(spark, sf_dir, "benchmark"), "text").select("doc_id")


@query("""
    WITH p AS (SELECT text, unnest(range(1, length(text) - 38, 40)) AS i FROM benchmark)
    SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM p WHERE contains(d.text, substr(p.text, p.i, 40)))""")
def benchmark_anchor_join(spark, sf_dir):
    """Documents that hold a piece of 40 characters of a benchmark passage."""
    texts = read_table(spark, sf_dir, "benchmark").where("length(text) >= 40")
    pieces = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text") - 39, F.lit(40))).alias("i"))
    return literals.literal_semi_join(read_table(spark, sf_dir, "documents"), "text", pieces.select(F.substring("text", F.col("i"), F.lit(40)).alias("piece")), "piece").select("doc_id")


@query("SELECT conv_id, turn, length(text) + 1 AS n, regexp_replace(text, '', '-', 'g') AS t FROM conversations")
def empty_matches(spark, sf_dir):
    """A pattern that would rather match nothing: one empty match before each character and one at the end."""
    p, text = compile("[a-z]*?"), F.col("text")
    return read_table(spark, sf_dir, "conversations").select("conv_id", "turn", p.count(text).cast("long").alias("n"), p.replace_all(text, "-").alias("t"))


@query("SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS token FROM documents) GROUP BY token) ORDER BY n DESC, token LIMIT 25")
def top_words(spark, sf_dir):
    return matches.token_counts(read_table(spark, sf_dir, "documents"), "text", compile("[A-Za-z]+")).orderBy(F.desc("n"), "token").limit(25)


@query("""
    WITH p AS (SELECT conv_id, turn, regexp_extract_all(text, '([^A-Z]*)([A-Z][a-z]*)', 1) AS g, regexp_extract_all(text, '([^A-Z]*)([A-Z][a-z]*)', 2) AS w FROM conversations),
    r AS (SELECT conv_id, turn, unnest(range(1, len(w) + 1)) AS i, unnest(g) AS g, unnest(w) AS w FROM p),
    s AS (SELECT *, sum(strlen(g) + strlen(w)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS e FROM r)
    SELECT conv_id, turn, CAST(i AS INTEGER) AS match_no, CAST(e - strlen(w) AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end", w AS text FROM s""")
def sql_matches(spark, sf_dir):
    """A pattern as a table function of SQL, of Spark's own functions."""
    matches.register_pattern(spark, "capital_words", compile("[A-Z][a-z]*"))
    read_table(spark, sf_dir, "conversations").createOrReplaceTempView("spanforge_conversations")
    return spark.sql("SELECT c.conv_id, c.turn, m.* FROM spanforge_conversations c, LATERAL capital_words(c.text) m")
