"""Names, slugs, yields, durations and lists as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators import yields
from .registry import query, t

#: Names as scrapers leave them, made from parts.
_RAW = """CASE p_partkey % 8 WHEN 0 THEN 'how to make ' || p_name WHEN 1 THEN p_name || ' recipe' WHEN 2 THEN 'recipe for the ' || p_name || ' of o''brien'
    WHEN 3 THEN replace(p_name, ' ', '-') || '_bbq''s best' WHEN 4 THEN '(' || p_name || '), with a ' || lower(p_type) WHEN 5 THEN 'Cook ' || p_name WHEN 6 THEN upper(p_name) ELSE '  ' || p_name || '  and ' END"""


def _raw(spark, d):
    return t(spark, d, "part").withColumn("raw", F.expr(_RAW.replace("''", "\\'")))


# SQL for clean_title on these names.
_SMALL, _ACRONYM = (", ".join(f"'{w}'" for w in words) for words in (text.SMALL_WORDS, text.ACRONYMS))
_CLEAN = rf"""array_to_string(list_transform(ws, lambda w, i:
    CASE WHEN c[i] = '' THEN w ELSE a[i] || CASE WHEN string_split(c[i], '''')[1] IN ({_ACRONYM}) THEN upper(string_split(c[i], '''')[1]) || substr(c[i], length(string_split(c[i], '''')[1]) + 1)
        WHEN i > 1 AND i < len(ws) AND c[i] IN ({_SMALL}) THEN c[i]
        WHEN contains(c[i], '''') AND strpos(c[i], '''') = 2 THEN upper(c[i][1]) || '''' || upper(c[i][3]) || substr(c[i], 4)
        ELSE upper(c[i][1]) || substr(c[i], 2) END || z[i] END), ' ')"""
_TITLES = rf"""WITH r AS (SELECT p_partkey, {_RAW} AS raw FROM part),
    s1 AS (SELECT *, trim(regexp_replace(translate(raw, '-_', '  '), '\s+', ' ', 'g')) AS s FROM r),
    s2 AS (SELECT *, trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(s, '^recipe\s+for\s+', '', 'i')), '^how\s+to\s+(make|cook)\s+', '', 'i')), '^how\s+to\s+', '', 'i')), '^(make|cook)\s+', '', 'i')), '\s+recipe$', '', 'i')) AS stripped FROM s1),
    s3 AS (SELECT *, string_split(lower(stripped), ' ') AS ws FROM s2),
    s4 AS (SELECT *, list_transform(ws, lambda w: regexp_extract(w, '^[,:;!?"''()-]*')) AS a, list_transform(ws, lambda w: regexp_extract(regexp_replace(w, '^[,:;!?"''()-]*', ''), '[,:;!?"''()-]*$')) AS z,
        list_transform(ws, lambda w: regexp_replace(regexp_replace(w, '^[,:;!?"''()-]*', ''), '[,:;!?"''()-]*$', '')) AS c FROM s3),
    titled AS (SELECT p_partkey, raw, {_CLEAN} AS title FROM s4)"""


@query(f"{_TITLES} SELECT * FROM titled")
def name_normalize(spark, d):
    return _raw(spark, d).select("p_partkey", "raw", text.clean_title(F.col("raw")).alias("title"))


@query(f"{_TITLES} SELECT p_partkey, title FROM titled WHERE title <> trim(raw) AND NOT regexp_matches(raw, '[A-Z]') AND trim(raw) <> ''")
def names_to_fix(spark, d):
    rows = _raw(spark, d).filter(text.needs_title(F.col("raw"), F.col("p_type")))
    return rows.select("p_partkey", text.clean_title(F.col("raw")).alias("title"))


_SLUG = "left(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 250)"


@query(f"SELECT p_partkey, {_SLUG.format('p_name || chr(32) || p_brand')} AS slug FROM part")
def slugify(spark, d):
    return t(spark, d, "part").select("p_partkey", text.plain_slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"))


@query(f"SELECT doc_id, {_SLUG.format('text')} AS slug, length(text) AS n FROM documents")
def document_slugs(spark, d):
    return t(spark, d, "documents").select("doc_id", text.plain_slug(F.col("text")).alias("slug"), F.length("text").cast("long").alias("n"))


@query(r"SELECT doc_id, lower(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))) AS key FROM documents")
def name_keys(spark, d):
    return t(spark, d, "documents").select("doc_id", text.name_key(F.substring_index("text", "\n", 1)).alias("key"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(coalesce(split_part(text, chr(10), 1), ''))), 'ß', 'ss'), '\s+', ' ', 'g')) AS key FROM documents""")
def folded_keys(spark, d):
    """Keys of the documents' first lines in any script (composed and case-folded).  The SQL has no compatibility forms; the tables have none either."""
    return t(spark, d, "documents").select("doc_id", text.folded_key(F.substring_index("text", "\n", 1)).alias("key"))


@query(r"""SELECT doc_id, left(regexp_replace(regexp_replace(replace(regexp_replace(lower(strip_accents(split_part(text, chr(10), 1))), '[^\x00-\x7F]', '', 'g'), chr(39), ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 250) AS slug FROM documents""")
def latin_slugs(spark, d):
    """Slugs of the documents' first lines, without accents."""
    return t(spark, d, "documents").select("doc_id", text.latin_slug(F.substring_index("text", "\n", 1)).alias("slug"))


@query("SELECT doc_id, CASE WHEN length(text) > 180 THEN left(text, 177) || '...' ELSE text END AS preview FROM documents")
def previews(spark, d):
    return t(spark, d, "documents").select("doc_id", text.short(F.col("text"), 180).alias("preview"))


@query("""SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(url, '/', ' ; '), '[;,]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS names FROM pages""")
def split_name_lists(spark, d):
    return t(spark, d, "pages").select("page_id", F.array_join(text.split_names(F.replace("url", F.lit("/"), F.lit(" ; "))), "|").alias("names"))


#: Yield texts made from parts, in every form that is understood and some that aren't.
_YIELD = """CASE p_partkey % 11 WHEN 0 THEN 'Serves ' || p_size WHEN 1 THEN p_size || ' servings' WHEN 2 THEN p_size || ' dozen cookies' WHEN 3 THEN '1 ' || (p_size % 7 + 1) || '/8 cups of it'
    WHEN 4 THEN p_size || '-' || (p_size + 2) WHEN 5 THEN 'a dozen' WHEN 6 THEN 'some' WHEN 7 THEN '' WHEN 8 THEN p_size || '.5' WHEN 9 THEN 'makes about ' || p_size || ' bars' ELSE (p_size % 7 + 1) || '/4 tray' END"""
_NUM = r"(\d+(?:\.\d+)?)"
_NOUNS = numbers.YIELD_NOUNS
_TOLD = rf"""CASE WHEN y = '' THEN NULL ELSE coalesce(
    TRY_CAST(nullif(regexp_extract(y, '(\d+)\s+dozen', 1, 'i'), '') AS DOUBLE) * 12, CASE WHEN regexp_matches(y, '\bdozen\b', 'i') THEN 12.0::DOUBLE END,
    TRY_CAST(nullif(regexp_extract(y, '(?:makes?|serves?|yields?|about)\s+{_NUM}', 1, 'i'), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(y, '^{_NUM}(?:\s*-\s*\d+(?:\.\d+)?)?\s+(?:{_NOUNS})', 1, 'i'), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(y, '^{_NUM}(?:\s*-\s*\d+(?:\.\d+)?)?$', 1), '') AS DOUBLE), nullif(q, 0)) END"""
_QUANTITY = rf"""CASE WHEN regexp_matches(y, '(\d+)\s+(\d+)/(\d+)') THEN CAST(regexp_extract(y, '(\d+)\s+(\d+)/(\d+)', 1) AS DOUBLE) + CAST(regexp_extract(y, '(\d+)\s+(\d+)/(\d+)', 2) AS DOUBLE) / CAST(regexp_extract(y, '(\d+)\s+(\d+)/(\d+)', 3) AS DOUBLE)
    WHEN regexp_matches(y, '(\d+)/(\d+)') THEN CAST(regexp_extract(y, '(\d+)/(\d+)', 1) AS DOUBLE) / CAST(regexp_extract(y, '(\d+)/(\d+)', 2) AS DOUBLE)
    ELSE coalesce(TRY_CAST(nullif(regexp_extract(y, '{_NUM}', 1), '') AS DOUBLE), 0) END"""
_YIELDS = f"WITH a AS (SELECT *, trim({_YIELD}) AS y FROM part), b AS (SELECT *, {_QUANTITY} AS q FROM a), told AS (SELECT *, {_TOLD} AS number FROM b)"


def _yields(spark, d):
    return t(spark, d, "part").withColumn("y", F.expr(_YIELD))


@query(f"{_YIELDS} SELECT p_partkey, y, number, q AS quantity FROM told")
def yield_parse(spark, d):
    return _yields(spark, d).select("p_partkey", "y", numbers.yield_number(F.col("y")).alias("number"), numbers.quantity(F.col("y")).alias("quantity"))


@query(f"""{_YIELDS}, n AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN 0.0 ELSE p_size * 0.5::DOUBLE END AS amount, CASE WHEN p_partkey % 6 IN (0, 1) THEN 0.0 ELSE p_size * 1.0::DOUBLE END AS servings FROM told),
    m AS (SELECT *, CASE WHEN amount <> 0 THEN amount ELSE servings END AS num FROM n),
    x AS (SELECT p_partkey, CASE WHEN y = '' AND num > 0 THEN 'set_text' WHEN y <> '' AND num = 0 AND number > 0 THEN 'set_servings' WHEN y <> '' AND servings > 0 AND amount = 0 THEN 'sync_qty' END AS action, y, num, number, servings FROM m)
    SELECT p_partkey, action, CASE action WHEN 'set_text' THEN CAST(CAST(floor(num) AS BIGINT) AS VARCHAR) || CASE WHEN floor(num) = 1 THEN ' serving' ELSE ' servings' END ELSE y END AS new_text,
        CASE action WHEN 'set_text' THEN num WHEN 'set_servings' THEN number ELSE servings END AS new_number FROM x WHERE action IS NOT NULL""")
def yield_gap_actions(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    amount, servings = F.when(key % 3 == 0, 0.0).otherwise(size * 0.5), F.when((key % 6).isin(0, 1), 0.0).otherwise(size * 1.0)
    return yields.planned(_yields(spark, d).withColumns({"amount": amount, "servings": servings}), "p_partkey", "y", "amount", "servings")


@query(r"""WITH s AS (SELECT p_partkey, p_retailprice / 10 AS sec FROM part), r AS (SELECT *, round_even(sec, 1) AS tenths, CAST(round_even(sec, 0) AS BIGINT) AS whole FROM s)
    SELECT p_partkey, CASE WHEN tenths < 60 THEN printf('%.1fs', tenths) ELSE (whole // 60) || 'm ' || (whole % 60) || 's' END AS elapsed,
        printf('%02d:%02d:%02d', CAST(floor(sec * 10) AS BIGINT) // 3600, CAST(floor(sec * 10) AS BIGINT) % 3600 // 60, CAST(floor(sec * 10) AS BIGINT) % 60) AS clock FROM r""")
def durations(spark, d):
    return t(spark, d, "part").select("p_partkey", numbers.elapsed(F.col("p_retailprice") / 10).alias("elapsed"), numbers.clock(F.col("p_retailprice") / 10 * 10).alias("clock"))


@query("""SELECT p_partkey, s // u AS n, CASE u WHEN 86400 THEN 'days' WHEN 3600 THEN 'hours' WHEN 60 THEN 'minutes' ELSE 'seconds' END AS unit FROM (SELECT p_partkey, s,
    CASE WHEN s % 86400 = 0 THEN 86400 WHEN s % 3600 = 0 THEN 3600 WHEN s % 60 = 0 THEN 60 ELSE 1 END AS u FROM (SELECT p_partkey, p_size * CASE p_partkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END AS s FROM part))""")
def interval_units(spark, d):
    seconds = F.expr("p_size * CASE p_partkey % 4 WHEN 0 THEN 86400 WHEN 1 THEN 3600 WHEN 2 THEN 60 ELSE 1 END")
    return t(spark, d, "part").select("p_partkey", numbers.interval_parts(seconds).alias("i")).select("p_partkey", "i.*")


@query("""SELECT p_partkey, array_to_string(CASE WHEN p_partkey % 2 = 0 THEN [p_name, p_brand] ELSE [p_name, p_type] END, '|') AS vals FROM part""")
def value_lists(spark, d):
    """Lists as JSON, and as text between commas."""
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_name", F.lit('", "'), "p_brand", F.lit('"'))).otherwise(F.concat("p_name", F.lit(" , '"), "p_type", F.lit("'")))
    return t(spark, d, "part").select("p_partkey", F.array_join(numbers.value_list(raw), "|").alias("vals"))


@query("SELECT p_partkey, left(sha256(p_name || '|' || p_brand), 16) AS version FROM part")
def versions(spark, d):
    return t(spark, d, "part").select("p_partkey", numbers.version(F.concat_ws("|", "p_name", "p_brand")).alias("version"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN NULL ELSE false END AS truth, least(30, greatest(3, p_size)) AS clamped FROM part""")
def coercions(spark, d):
    said = F.element_at(F.array(*map(F.lit, [" TRUE ", "no", "1", "perhaps", "off"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", numbers.truth(said).alias("truth"), numbers.clamped(F.col("p_size").cast("string"), 7, 3, 30).alias("clamped"))


@query("SELECT event_id, date_trunc('minute', ts) AS minute, ts AS exact FROM events")
def moments(spark, d):
    """Times written as text with and without seconds and zone, and read again."""
    events = t(spark, d, "events")
    return events.select("event_id", numbers.moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).alias("minute"), numbers.moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("exact"))


_REPLIES = """CASE p_partkey % 10 WHEN 0 THEN '[{"slug": "' || p_name || '", "tags": ["x"]}]' WHEN 1 THEN '```json\n[{"slug": "' || p_name || '"}]\n```' WHEN 2 THEN 'Sure! Here it is: [{slug: "' || p_name || '", "tags": ["x",],}] Enjoy.'
    WHEN 3 THEN '“not json”' WHEN 4 THEN '{"results": [{"slug": "' || p_name || '"}]}' WHEN 5 THEN '[{"slug": "' || p_name || '"}, {"slug": "f", "ta' WHEN 6 THEN concat('[{', chr(39), 'slug', chr(39), ': ', chr(39), p_name, chr(39), '}]') WHEN 7 THEN '' WHEN 8 THEN NULL
    ELSE '[{“slug”: “' || p_name || '”, "url": "https://x.org/a, b: c"}]' END"""


@query("""SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN '[{"slug": "' || p_name || '", "tags": ["x"]}]' WHEN 1 THEN '[{"slug": "' || p_name || '"}]' WHEN 2 THEN '[{"slug": "' || p_name || '", "tags": ["x"]}]' WHEN 4 THEN '[{"slug": "' || p_name || '"}]'
    WHEN 5 THEN '[{"slug": "' || p_name || '"}]' WHEN 6 THEN '[{"slug": "' || p_name || '"}]' WHEN 9 THEN '[{"slug": "' || p_name || '", "url": "https://x.org/a, b: c"}]' END AS json FROM part""")
def json_repair(spark, d):
    """Model replies in every kind of disorder, as JSON; null where nothing can be saved."""
    return t(spark, d, "part").select("p_partkey", F.expr(_REPLIES).alias("reply")).select("p_partkey", numbers.repaired_json("reply").alias("json"))
