"""Queries over the driver's tables, one per operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import geometry as G
from spanloom.functions import text as T
from spanloom.operators import marks, outputs
from spanloom.operators.locate import locate_exact
from spanloom.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def both(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


@query("""
SELECT b.item_id AS seq, d.doc_id, strpos(lower(d.text), lower(b.text)) - 1 AS start,
       strpos(lower(d.text), lower(b.text)) - 1 + length(b.text) AS "end", 'exact' AS method
FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))""")
def locate_exact_(spark, d):
    return locate_exact(X.table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), "text"), X.table(spark, d, "documents"))


QUERIES["locate_exact"], SQL["locate_exact"] = QUERIES.pop("locate_exact_"), SQL.pop("locate_exact_")

NORMAL = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(translate(raw, chr(8217) || chr(8211) || chr(160), '''- '), '-\s*\n\s*', '', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g')))"


@query(both(X.SQL_DAMAGED) + f"SELECT doc_id, {NORMAL} AS norm FROM fx_damaged")
def normalize_text(spark, d):
    return X.damaged(spark, d).select("doc_id", T.normalize_text(F.col("raw")).alias("norm"))


@query(both(X.SQL_DAMAGED) + r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(replace(raw, chr(160), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g')) AS shown FROM fx_damaged""")
def clean_display_text(spark, d):
    return X.damaged(spark, d).select("doc_id", T.clean_display(F.col("raw")).alias("shown"))


LONE = "(^|[^A-Za-zÀ-ɏ0-9_])[A-Za-zÀ-ɏ]"


@query(rf"""
SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\s+[.,;:!?)]')) + len(regexp_extract_all(text, '[(„“"'']\s+'))
       + len(regexp_extract_all(text, '{LONE}\s+[A-Za-zÀ-ɏ]{{2,}}')) + len(regexp_extract_all(text, '{LONE}\s+[A-Za-zÀ-ɏ]\s+[A-Za-zÀ-ɏ]')) AS INT) AS score
FROM (SELECT conv_id, turn, regexp_replace(text, '(\w)([.,])', '\1 \2', 'g') AS text FROM conversations) t""")
def broken_output_score(spark, d):
    text = F.regexp_replace("text", "([0-9A-Za-z_])([.,])", "$1 $2")
    return X.table(spark, d, "conversations").select("conv_id", "turn", T.broken_output_score(text).alias("score"))


@query(r"""
WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations),
t AS (SELECT conv_id, turn, CAST(unnest(range(len(lines))) AS INT) AS line, trim(unnest(lines)) AS s FROM l),
u AS (SELECT *, len(regexp_extract_all(s, '[0-9A-Za-zÀ-ɏ]+')) AS words, len(regexp_extract_all(s, '\p{L}')) AS letters, len(regexp_extract_all(s, '\p{Lu}')) AS upper FROM t)
SELECT conv_id, turn, line, length(s) BETWEEN 1 AND 120 AND NOT regexp_matches(s, '[.!?;,]$') AND words BETWEEN 2 AND 12 AND letters > 0
       AND (upper / greatest(letters, 1) >= 0.72 OR NOT regexp_matches(s, '(^|\s)[^\s0-9\p{Lu}]')) AS heading FROM u""")
def heading_like(spark, d):
    rows = X.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    return rows.select("conv_id", "turn", "line", T.heading_like(F.col("s")).alias("heading"))


@query(r"""
SELECT doc_id, CASE WHEN regexp_matches(text, '^[\p{L}\p{N}"“‘(\[]') THEN 0.5::DOUBLE ELSE 0 END
             + CASE WHEN regexp_matches(text, '[\p{L}\p{N}.!?"”’)*\]]\z') THEN 0.5::DOUBLE ELSE 0 END AS score FROM documents""")
def boundary_score(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.boundary_score(F.col("text")).alias("score"))


PALETTE_SQL = ", ".join(f"({i}, '{n}', {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for i, (n, x, y, z) in enumerate(G.PALETTE))


@query(f"""
WITH c AS (SELECT o_orderkey AS k, (o_orderkey * 37 % 256) / 255::DOUBLE AS r, (o_orderkey * 91 % 251) / 255::DOUBLE AS g, (o_custkey * 57 % 256) / 255::DOUBLE AS b FROM orders),
p(i, name, x, y, z) AS (VALUES {PALETTE_SQL}),
m AS (SELECT c.*, name, sqrt((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)) AS dist,
             row_number() OVER (PARTITION BY k ORDER BY sqrt((r - x) * (r - x) + (g - y) * (g - y) + (b - z) * (b - z)), i) AS nth FROM c, p)
SELECT k, CASE WHEN (r + g + b) / 3 < 0.5 OR (r + g + b) / 3 > 0.95 THEN NULL WHEN dist <= 0.22 THEN name
  WHEN g > r AND g > b AND g > 0.65 THEN 'green' WHEN r > 0.75 AND g > 0.65 AND b < 0.65 THEN 'yellow' WHEN r > 0.75 AND b > 0.75 AND g < 0.75 THEN 'pink'
  WHEN b > 0.7 AND r < 0.7 AND g < 0.9 THEN 'blue' WHEN r > 0.7 AND g < 0.55 AND b < 0.55 THEN 'red' END AS color FROM m WHERE nth = 1""")
def classify_color(spark, d):
    c = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("(o_orderkey * 37 % 256) / 255D").alias("r"), F.expr("(o_orderkey * 91 % 251) / 255D").alias("g"), F.expr("(o_custkey * 57 % 256) / 255D").alias("b"))
    return c.select("k", G.classify_color(F.col("r"), F.col("g"), F.col("b")).alias("color"))


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """
SELECT doc_id, page_no, color, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, sum(greatest(x1 - x0, 0) * greatest(y1 - y0, 0)) AS area
FROM fx_rects GROUP BY ALL""")
def rect_area_bbox(spark, d):
    r = X.rects(X.words(spark, d))
    return r.groupBy("doc_id", "page_no", "color").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum(G.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))).alias("area"))


@query(both(X.SQL_WORDS, X.SQL_RECTS, X.SQL_HITS) + "SELECT doc_id, page_no, rect_id, word_idx, round(overlap, 6) AS overlap FROM fx_hits")
def word_rect_hits(spark, d):
    w = X.words(spark, d)
    return marks.word_rect_hits(w, X.rects(w)).withColumn("overlap", F.round("overlap", 6))


@query(both(X.SQL_WORDS, X.SQL_RECTS, X.SQL_HITS) + """
SELECT doc_id, page_no, rect_id, color FROM fx_rects r WHERE (x1 - x0) * (y1 - y0) >= 25
AND NOT EXISTS (SELECT 1 FROM fx_hits h WHERE h.doc_id = r.doc_id AND h.page_no = r.page_no AND h.rect_id = r.rect_id)""")
def image_rects(spark, d):
    w = X.words(spark, d)
    r = X.rects(w)
    return marks.image_rects(r, marks.word_rect_hits(w, r)).select("doc_id", "page_no", "rect_id", "color")


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """, f AS (
SELECT *, max(y1) OVER (PARTITION BY doc_id, page_no, color ORDER BY y0, x0, rect_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fx_rects)
SELECT doc_id, page_no, color, rect_id, CAST(sum(CASE WHEN top IS NULL OR y0 - top >= 8 THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page_no, color ORDER BY y0, x0, rect_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM f""")
def vertical_islands(spark, d):
    return marks.vertical_islands(X.rects(X.words(spark, d))).select("doc_id", "page_no", "color", "rect_id", "island")


@query()
def passages_fold(spark, d):
    w = X.words(spark, d)
    r = X.rects(w)
    return marks.passages(w, r, marks.word_rect_hits(w, r)).select("doc_id", "page_no", "color", "passage", F.size("rect_ids").alias("n_rects"), F.array_join("word_idx", ",").alias("word_idx"))


@query()
def extract_highlights(spark, d):
    """Every passage of text; ``marks.highlights`` is the same on tables of words and rects."""
    return marks.text_only(marks.marked_units(X.units(spark, d)))


@query(both(X.SQL_WORDS) + """
SELECT doc_id, page_no, word_idx,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY doc_id, page_no ORDER BY word_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), '') AS before,
  coalesce(string_agg(text, ' ') OVER (PARTITION BY doc_id, page_no ORDER BY word_idx ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING), '') AS after FROM fx_words""")
def context_windows(spark, d):
    return marks.context_windows(X.words(spark, d))


SPANS_SQL = r"""n AS (SELECT doc_id, page_no, word_idx, lower(trim(regexp_replace(regexp_replace(text, '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'))) AS norm FROM fx_words)"""


@query(both(X.SQL_WORDS, SPANS_SQL) + """
SELECT doc_id, page_no, word_idx, norm, CAST(coalesce(sum(length(norm) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(length(norm) + 1) OVER w, 0) + length(norm) AS BIGINT) AS "end"
FROM n WHERE norm <> '' WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def page_text_spans(spark, d):
    return marks.page_spans(X.words(spark, d))


@query(both(X.SQL_WORDS, SPANS_SQL) + "SELECT doc_id, page_no, string_agg(norm, ' ' ORDER BY word_idx) AS norm_text FROM n WHERE norm <> '' GROUP BY ALL")
def page_text(spark, d):
    return marks.page_text(X.words(spark, d))


@query(both(X.SQL_WORDS, X.SQL_RECTS, X.SQL_HITS) + """, m AS (SELECT * FROM fx_words w WHERE EXISTS (SELECT 1 FROM fx_hits h WHERE h.doc_id = w.doc_id AND h.page_no = w.page_no AND h.word_idx = w.word_idx)),
f AS (SELECT *, coalesce(lag(line_no) OVER v = line_no AND x0 - lag(x1) OVER v <= 25, false) AS goes_on FROM m WINDOW v AS (PARTITION BY doc_id, page_no ORDER BY word_idx)),
g AS (SELECT *, CAST(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY word_idx ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS quad FROM f)
SELECT doc_id, page_no, quad, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM g GROUP BY ALL""")
def line_quads(spark, d):
    w = X.words(spark, d)
    return marks.line_quads(w, marks.word_rect_hits(w, X.rects(w)))


@query(both(X.SQL_WORDS, X.SQL_RECTS, X.SQL_HITS) + """, h AS (SELECT DISTINCT doc_id, page_no, rect_id FROM fx_hits)
SELECT r.doc_id, r.color, count(*) AS n_rects, count(h.rect_id) AS n_text, count(*) FILTER (WHERE h.rect_id IS NULL AND (x1 - x0) * (y1 - y0) >= 25) AS n_image
FROM fx_rects r LEFT JOIN h ON r.doc_id = h.doc_id AND r.page_no = h.page_no AND r.rect_id = h.rect_id GROUP BY ALL""")
def color_stats(spark, d):
    w = X.words(spark, d)
    r = X.rects(w)
    marked = marks.word_rect_hits(w, r).select("doc_id", "page_no", "rect_id").distinct().withColumn("hit", F.lit(True))
    large = G.area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) >= 25
    return r.join(marked, ["doc_id", "page_no", "rect_id"], "left").groupBy("doc_id", "color").agg(F.count("*").alias("n_rects"), F.count_if("hit").alias("n_text"), F.count_if(F.col("hit").isNull() & large).alias("n_image"))


@query(both(X.SQL_DAMAGED) + r"""
SELECT unicode(c) AS code, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(replace(raw, 'qu', chr(1)), 'z', chr(11)), '[\x00-\x08\x0b\x0c\x0e-\x1f]')) AS c FROM fx_damaged)
WHERE unicode(c) NOT IN (0, 16, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31) GROUP BY ALL""")
def control_char_census(spark, d):
    raw = F.replace(F.replace("raw", F.lit("qu"), F.lit("\x01")), F.lit("z"), F.lit("\x0b"))
    return marks.control_census(X.damaged(spark, d).select(raw.alias("text")))


LEXICON = r"lex AS (SELECT text AS word FROM fx_words WHERE regexp_matches(text, '^[a-z]+$') GROUP BY text HAVING count(*) >= 3)"


@query(both(X.SQL_WORDS, LEXICON) + "SELECT doc_id, count(*) AS n_known FROM (SELECT DISTINCT doc_id, lower(text) AS word FROM fx_words) JOIN lex USING (word) GROUP BY ALL")
def distinct_word_lookup(spark, d):
    w = X.words(spark, d)
    lexicon = w.filter(F.col("text").rlike("^[a-z]+\\z")).groupBy(F.col("text").alias("word")).count().filter("count >= 3").select("word")
    return w.select("doc_id", F.lower("text").alias("word")).distinct().join(lexicon, "word", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_known"))


@query(both(X.SQL_WORDS, LEXICON) + """
SELECT lower(text) AS word, min_by(doc_id, doc_id * 1000000 + word_idx) AS doc_id, min_by(word_idx, doc_id * 1000000 + word_idx) AS word_idx, count(*) AS n
FROM fx_words WHERE lower(text) NOT IN (SELECT word FROM lex) GROUP BY ALL""")
def unresolved_first_context(spark, d):
    w = X.words(spark, d)
    lexicon = w.filter(F.col("text").rlike("^[a-z]+\\z")).groupBy(F.col("text").alias("word")).count().filter("count >= 3").select("word")
    unknown = w.select("doc_id", "word_idx", F.lower("text").alias("word")).join(lexicon, "word", "left_anti")
    return unknown.groupBy("word").agg(F.min(F.struct("doc_id", "word_idx")).alias("at"), F.count("*").alias("n")).select("word", "at.doc_id", "at.word_idx", "n")


@query("""
SELECT doc_id, string_agg(CAST(p AS VARCHAR), ',' ORDER BY CASE WHEN abs(p - hint) <= 3 THEN abs(p - hint) ELSE 4 END, p) AS pages
FROM (SELECT doc_id, doc_id % (n_chars // 400 + 1) AS hint, unnest(range(n_chars // 400 + 1)) AS p FROM documents) GROUP BY doc_id""")
def scan_order(spark, d):
    n = F.expr("n_chars div 400 + 1")
    return X.table(spark, d, "documents").select("doc_id", F.array_join(outputs.scan_order(F.col("doc_id") % n, n).cast("array<string>"), ",").alias("pages"))


@query("""
SELECT seq, scan_pos, score FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY (score >= 0.86) DESC, CASE WHEN score >= 0.86 THEN scan_pos END, score DESC, scan_pos) AS n
FROM (SELECT o_custkey AS seq, o_orderkey AS scan_pos, (o_orderkey * 7919 % 97) / 100::DOUBLE AS score FROM orders)) WHERE n = 1""")
def confident_pick(spark, d):
    s = X.table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("scan_pos"), F.expr("(o_orderkey * 7919 % 97) / 100D").alias("score"))
    return outputs.confident_pick(s, ["seq"])


@query("""
SELECT reason, count(*) AS n FROM (SELECT b.item_id, CASE WHEN length(b.text) < 4 THEN 'context_too_short' WHEN count(d.doc_id) = 0 THEN 'no_candidate_windows' ELSE 'matched' END AS reason
FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)) GROUP BY b.item_id, b.text) GROUP BY ALL""")
def failure_reason_histogram(spark, d):
    needles = X.table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), "text")
    found = locate_exact(needles, X.table(spark, d, "documents")).select("seq").distinct().withColumn("hit", F.lit(True))
    reason = F.when(F.length("text") < 4, "context_too_short").when(F.col("hit").isNull(), "no_candidate_windows").otherwise("matched")
    return needles.join(found, "seq", "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, count(*) FILTER (WHERE quality = 0) AS n_unmatched, count(*) FILTER (WHERE toxic = 1) AS n_unresolved,
  CASE WHEN count(*) FILTER (WHERE quality = 0 OR toxic = 1) > 0 THEN 'needs_review' ELSE 'final' END AS status FROM labels GROUP BY doc_id""")
def review_gate(spark, d):
    return outputs.review_gate(X.table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).alias("unmatched"), (F.col("toxic") == 1).alias("unresolved")))


@query("""
WITH e AS (SELECT conv_id AS doc_id, turn AS seq, role AS section, 'p.' || turn AS location, text, ['yellow','green','pink'][CAST(turn % 3 AS INT) + 1] AS color, turn % 5 = 4 AS is_image, turn % 4 <> 3 AS matched FROM conversations),
l AS (SELECT doc_id, section, seq, CASE WHEN is_image THEN '- image highlight _(' || color || ')_ [' || location || ']'
   ELSE CASE WHEN matched THEN '> ' ELSE '> [not mapped with confidence] ' END || text || CASE WHEN color <> 'yellow' THEN ' _(' || color || ')_' ELSE '' END || ' [' || location || ']' END AS line FROM e),
p AS (SELECT doc_id, min(seq) AS first, '## ' || section || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY seq, line) || chr(10) AS part FROM l GROUP BY doc_id, section)
SELECT doc_id, string_agg(part, chr(10) ORDER BY first, part) AS markdown FROM p GROUP BY doc_id""")
def notes_markdown(spark, d):
    color = F.element_at(F.array(F.lit("yellow"), F.lit("green"), F.lit("pink")), F.expr("int(turn % 3) + 1"))
    e = X.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.col("role").alias("section"), F.concat(F.lit("p."), F.col("turn")).alias("location"), "text", color.alias("color"), (F.col("turn") % 5 == 4).alias("is_image"), (F.col("turn") % 4 != 3).alias("matched"))
    return outputs.notes(e)


@query("""SELECT doc_id, rect_id, row_number() OVER (PARTITION BY doc_id ORDER BY n_end - n_start DESC, n_start, n_end, rect_id) AS nth FROM (SELECT l_orderkey AS doc_id, l_linenumber AS rect_id, l_partkey % 50 AS n_start, l_partkey % 50 + l_suppkey % 7 AS n_end FROM lineitem)""")
def wrap_order(spark, d):
    @F.udf("array<bigint>", useArrow=True)
    def ordered(ms):
        from spanloom.functions import markup

        return [m["rect_id"] for m in sorted(ms, key=lambda m: markup.wrap_order((m["s"], m["e"], "")))]

    r = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("rect_id"), F.expr("l_partkey % 50").alias("s"), F.expr("l_partkey % 50 + l_suppkey % 7").alias("e"))
    per = r.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rect_id", "s", "e"))).alias("ms"))
    return per.select("doc_id", F.posexplode(ordered("ms")).alias("nth", "rect_id")).select("doc_id", "rect_id", (F.col("nth") + 1).cast("long").alias("nth"))


LABEL_SQL = r"""lab AS (SELECT page_id, html, lower(trim(regexp_replace(regexp_replace(regexp_replace(coalesce(nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<h2[^>]*>(.*?)</h2>', 1)), ''),
 nullif(trim(regexp_extract(html, '(?is)<h3[^>]*>(.*?)</h3>', 1)), ''), nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), ''), 'page'), '<[^>]*>', '', 'g'), '\s*-\s*', '-', 'g'), '\s+', ' ', 'g'))) AS label FROM pages)"""


def _label():
    tags = [F.nullif(F.trim(F.regexp_extract("html", f"(?is)<{t}[^>]*>(.*?)</{t}>", 1)), F.lit("")) for t in ("h1", "h2", "h3", "title")]
    return T.normalize_text(F.regexp_replace(F.coalesce(*tags, F.lit("page")), "<[^>]*>", ""))


def _labels(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", _label().alias("label"))


@query(both(LABEL_SQL) + "SELECT page_id, substr(label, 1, 120) AS label FROM lab")
def section_labels(spark, d):
    return _labels(X.table(spark, d, "pages")).select("page_id", F.substring("label", 1, 120).alias("label"))


@query(both(LABEL_SQL) + """, t AS (SELECT a.page_id, a.label, CASE b.page_id % 3 WHEN 0 THEN b.label WHEN 1 THEN string_split(b.label, ' ')[-1] ELSE string_split(b.label, ' ')[1] END AS target
 FROM lab a JOIN lab b ON b.page_id BETWEEN a.page_id AND a.page_id + 2)
SELECT page_id, target, label <> '' AND target <> '' AND (label = target OR ends_with(label, target) OR ends_with(target, label) OR contains(label, target)) AS matched FROM t""")
def label_match(spark, d):
    """Each label against whole labels, first words and last words of its own page and the next two."""
    a = _labels(X.table(spark, d, "pages"))
    word, n = F.split("label", " "), F.col("page_id") % 3
    b = a.select(F.explode(F.array(*[F.col("page_id") - i for i in range(3)])).alias("page_id"), F.when(n == 0, F.col("label")).when(n == 1, F.element_at(word, -1)).otherwise(F.element_at(word, 1)).alias("target"))
    return a.join(b, "page_id").select("page_id", "target", T.label_matches(F.col("label"), F.col("target")).alias("matched"))


@query(r"""
WITH m AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/(\d+)$', '/../\1') AS name FROM pages)
SELECT page_id, CASE WHEN name = '' THEN 'empty' WHEN contains(name, chr(92)) THEN 'backslash' WHEN starts_with(name, '/') THEN 'absolute' WHEN regexp_matches(name, '^[A-Za-z]:') THEN 'drive'
  WHEN regexp_matches(name, '(^|/)(\.|\.\.)?(/|$)') AND (regexp_matches(name, '(^|/)(\.|\.\.)(/|$)') OR contains(name, '//') OR name = '/') THEN 'parts' END AS error FROM m""")
def member_validation(spark, d):
    name = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "/(\\d+)\\z", "/../$1")
    return X.table(spark, d, "pages").select("page_id", outputs.member_error(name).alias("error"))


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """
SELECT doc_id, rect_id, substr(sha256('{"color":"' || color || '","geometry":[' || CAST(x0 AS BIGINT) || ',' || CAST(y0 AS BIGINT) || ',' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT)
  || '],"kind":"text","page_index":' || page_no || ',"text":"line ' || rect_id || '"}'), 1, 32) AS annotation_key FROM fx_rects""")
def stable_ids(spark, d):
    box = F.array(*[F.col(c).cast("long") for c in ("x0", "y0", "x1", "y1")])
    key = outputs.stable_key(F.lit("text"), F.col("page_no"), F.col("color"), F.concat(F.lit("line "), F.col("rect_id")), box)
    return X.rects(X.words(spark, d)).select("doc_id", "rect_id", key.alias("annotation_key"))


@query("SELECT doc_id, rtrim(regexp_replace(to_base64(encode(text)), '(.{76})', '\\1' || chr(10), 'g'), chr(10)) AS payload FROM documents")
def bookmark_payload(spark, d):
    return X.table(spark, d, "documents").select("doc_id", outputs.payload(F.col("text")).alias("payload"))


@query("SELECT doc_id AS seq, text, lang AS color, CAST(n_chars % 7 AS INT) AS page_no FROM documents")
def highlight_json_roundtrip(spark, d):
    from spanloom.sources.highlights import decode, encode

    h = X.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("color"), "text", F.expr("int(n_chars % 7)").alias("page_no"), F.expr("array(double(0), double(1), double(2), double(3))").alias("bbox"))
    return decode(encode(h)).select("seq", "text", "color", "page_no")


@query(both(X.SQL_WORDS) + r""", p AS (SELECT doc_id, word_idx, lower(text) AS cur, lag(text) OVER (PARTITION BY doc_id ORDER BY word_idx) AS piece FROM fx_words)
SELECT doc_id, word_idx, coalesce(regexp_matches(cur, '^\p{Ll}') AND lower(piece) NOT IN ('in','out','buy','sell','call','put','long','short')
  AND (length(piece) >= 4 OR lower(piece) = 'vol' OR (length(piece) >= 3 AND regexp_matches(piece, '^\p{Lu}'))), false) AS merged FROM p""")
def hyphen_merges(spark, d):
    from pyspark.sql import Window

    w = X.words(spark, d).select("doc_id", "word_idx", F.lower("text").alias("cur"), F.concat(F.lag("text").over(Window.partitionBy("doc_id").orderBy("word_idx")), F.lit("-")).alias("prev"))
    return w.select("doc_id", "word_idx", T.merges_hyphen(F.col("prev"), F.col("cur")).alias("merged"))


@query("""
SELECT item_id AS seq, '{"color":"yellow","page":' || (item_id % 9 + 1) || ',"raw_text":"' || replace(replace(replace(text, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n')
  || '","repaired_text":"r","context_before":"","context_after":"","reason":"' || CASE WHEN item_id % 2 = 0 THEN 'no_fuzzy_match' ELSE 'unknown' END || '"' || CASE WHEN item_id % 3 > 0 THEN ',"candidate_count":' || (item_id % 3) ELSE '' END || '}' AS entry FROM benchmark""")
def unmatched_entries(spark, d):
    n = F.col("item_id")
    f = X.table(spark, d, "benchmark").select(
        n.alias("seq"), F.lit("yellow").alias("color"), (n % 9).alias("page_no"), F.col("text").alias("raw_text"), F.lit("r").alias("text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"),
        F.when(n % 2 == 0, "no_fuzzy_match").alias("reason"), (n % 3).alias("candidate_count"), F.lit(None).cast("double").alias("best_score"), F.lit("").alias("best_method"),
    )
    return outputs.unmatched_json(f)


@query("""
WITH p AS (SELECT doc_id, unnest(s) AS part, unnest(range(len(s))) AS i, len(s) AS n FROM (SELECT doc_id, string_split(lower(text), 'the') AS s FROM documents)),
q AS (SELECT doc_id, i, n, CAST(sum(length(part) + 3) OVER (PARTITION BY doc_id ORDER BY i) - 3 AS BIGINT) AS start FROM p)
SELECT doc_id, i AS nth, start, start + 3 AS "end" FROM q WHERE i < n - 1 AND i < 8""")
def literal_spans_topk(spark, d):
    from spanloom.operators.place import spans_udf

    found = X.table(spark, d, "documents").select("doc_id", F.posexplode(spans_udf("literal")("text", F.lit("the"))).alias("nth", "s"))
    return found.select("doc_id", F.col("nth").cast("long").alias("nth"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def _needles(text):
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit("[a-z]{6,}"), F.lit(0)))


def _split_in_place(text, needle):
    cut = F.concat(F.substring(needle, 1, 3), F.lit("- "), F.substring(F.col(needle), F.lit(4), F.length(needle)))
    return F.replace(F.col(text), F.col(needle), cut)


@query(r"""
WITH t AS (SELECT conv_id, turn, lower(text) AS text FROM conversations),
n AS (SELECT conv_id, turn, text, unnest(list_distinct(regexp_extract_all(text, '[a-z]{6,}'))) AS needle FROM t)
SELECT conv_id, turn, needle, CAST(len(p) - 1 AS INT) AS n_spans,
       array_to_string(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], '')) + (i - 1) * (length(needle) + 2)), ',') AS starts
FROM (SELECT *, string_split(text, needle) AS p FROM n)""")
def line_hyphen_spans(spark, d):
    """All places of every needle of every turn, split in the turn's own text."""
    from spanloom.operators.place import spans_udf

    t = X.table(spark, d, "conversations").select("conv_id", "turn", F.lower("text").alias("text"))
    t = t.select("conv_id", "turn", "text", F.explode(_needles("text")).alias("needle"))
    t = t.select("conv_id", "turn", "needle", spans_udf("line_hyphen", None)(_split_in_place("text", "needle"), "needle").alias("s"))
    return t.select("conv_id", "turn", "needle", F.size("s").alias("n_spans"), F.array_join(F.col("s.start").cast("array<string>"), ",").alias("starts"))


def _line_pairs(t: DataFrame) -> DataFrame:
    """Damage leaves line breaks as they are, so lines pair by number."""
    lines = lambda c: F.split(F.coalesce(c, F.lit("")), "\n", -1)
    return t.select(*(c for c in t.columns if c not in ("text", "raw")), F.posexplode(F.arrays_zip(lines(F.col("text")).alias("text"), lines(F.col("raw")).alias("raw"))).alias("line", "p"))


@query()
def similarity_ratio(spark, d):
    from spanloom.operators.place import similarity

    t = _line_pairs(X.damaged(spark, d))
    return t.select("doc_id", "line", F.round(similarity(F.col("p.text"), F.col("p.raw")), 6).alias("ratio"))


def _glyph_options() -> dict[str, list[str]]:
    """Damaged glyphs of the fixture with all they may stand for, in the order they are tried."""
    from spanloom.config import SUBSTITUTIONS
    from spanloom.functions.matching import LIGATURES

    return {chr(code): list(dict.fromkeys([chr(code), *SUBSTITUTIONS[chr(code)], *LIGATURES])) for _, code in X.DAMAGE[:4]}


def _glyph_sql() -> str:
    out = "needle"
    for c, options in _glyph_options().items():
        out = f"replace({out}, chr({ord(c)}), '(?:' || chr({ord(c)}) || '|{'|'.join(options[1:])})')"
    return out


@query(both(X.SQL_DAMAGED, r"n AS (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(raw, '[a-z]*[\x12-\x15][a-z]*')) AS needle FROM fx_damaged)") + f"""
SELECT doc_id, needle, CAST(len(regexp_extract_all(text, '(?i)' || {_glyph_sql()})) AS INT) AS n FROM n""")
def flexible_regex(spark, d):
    """Every damaged word searched in its document's undamaged whole text."""
    from spanloom.operators.place import spans_udf

    t = X.damaged(spark, d).select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("raw", F.lit("[a-z]*[\\x12-\\x15][a-z]*"), F.lit(0)))).alias("needle"))
    return t.select("doc_id", "needle", F.size(spans_udf("flexible", None)("text", "needle")).alias("n")).distinct()


@query()
def repair_words(spark, d):
    from spanloom.operators.place import repair

    w = X.words(spark, d)
    lexicon = w.filter(F.col("text").rlike("^[a-z]+\\z")).groupBy(F.col("text").alias("word")).count().filter("count >= 3").select("word")
    out = repair(X.damaged(spark, d).select("doc_id", "raw"), lexicon, text="raw")
    return out.select("doc_id", F.length("repaired").alias("n_chars"), F.size("unresolved").alias("n_unresolved"))


@query()
def place_pages(spark, d):
    """Benchmark passages placed in the documents that hold them, page by page."""
    from spanloom.operators.place import place

    docs, w = X.table(spark, d, "documents"), X.words(spark, d)
    needles = X.table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), "text")
    found = locate_exact(needles, docs).select("doc_id", "seq").join(F.broadcast(needles), "seq")
    h = found.select("doc_id", "seq", "text", F.col("text").alias("raw_text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"), F.lit(0).alias("page_no"))
    pages = marks.page_text(w.join(found.select("doc_id").distinct(), "doc_id", "left_semi")).select("doc_id", F.col("page_no").cast("int").alias("container"), "norm_text")
    return place(h, pages).select("doc_id", "seq", "container", "start", "end", F.round("score", 6).alias("score"), "method", "reason")


@query()
def html_text_map(spark, d):
    """Normal text and label of every page, read as markup."""
    import hashlib

    def run(frames):
        from spanloom.functions.markup import Section

        for f in frames:
            made = [Section.read((h or "").encode()) for h in f["html"]]
            yield f[["page_id"]].assign(label=[s.label for s in made], n_chars=[len(s.norm) for s in made], norm_sha256=[hashlib.sha256(s.norm.encode()).hexdigest() for s in made])

    return X.table(spark, d, "pages").select("page_id", "html").mapInPandas(run, "page_id long, label string, n_chars long, norm_sha256 string")


def _books(spark, d):
    from spanloom.sources.packages import single_section

    made = F.udf(lambda html: single_section("", html), "binary", useArrow=True)
    return X.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), made(F.coalesce("html", F.lit(""))).alias("content"))


@query()
def book_sections(spark, d):
    """Every page packed as a book, read again section by section."""
    from spanloom.sources.packages import sections

    return sections(_books(spark, d))


@query()
def annotate_books(spark, d):
    """Every page packed as a book; its label and its shortest stretch of 20 characters or more are highlighted."""
    from spanloom.operators.books import annotate

    pages = X.table(spark, d, "pages").select("page_id", _label().alias("label"), F.regexp_replace("html", "<[^>]*>", "\n").alias("plain"))
    lines = F.array_sort(F.transform(F.split("plain", "\n"), lambda t: F.struct((-F.length(F.trim(t))).alias("n"), F.trim(t).alias("t"))))
    wanted = F.array(F.struct(F.lit("green").alias("color"), F.col("label").alias("text")), F.struct(F.lit("yellow").alias("color"), F.coalesce(F.get(lines, F.lit(0))["t"], F.lit("")).alias("text")))
    h = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(wanted).alias("seq", "w")).select("doc_id", F.col("seq").cast("long").alias("seq"), "w.color", "w.text", F.col("w.text").alias("raw_text"), F.lit("").alias("context_before"), F.lit("").alias("context_after"), F.lit(False).alias("is_image"))
    out = annotate(h, _books(spark, d))
    return out.select("doc_id", "seq", "section", "start", "end", F.round("score", 6).alias("score"), "matched_text", "method", "start_path", "end_path", "reason", F.sha2("content", 256).alias("content_sha256"))


@query(both(X.SQL_WORDS) + """
SELECT doc_id, word_idx, coalesce(x0 < lag(x0) OVER w OR y0 - lag(y0) OVER w > 2, false) AS breaks FROM fx_words WINDOW w AS (PARTITION BY doc_id ORDER BY word_idx)""")
def line_breaks(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("word_idx")
    breaks = T.is_line_break(F.lag("x0").over(w), F.lag("y0").over(w), F.col("x0"), F.col("y0"))
    return X.words(spark, d).select("doc_id", "word_idx", F.coalesce(breaks, F.lit(False)).alias("breaks"))


@query(both(X.SQL_DAMAGED) + r"""
SELECT doc_id, count(*) FILTER (WHERE length(t) < 3 OR regexp_matches(t, '[\x00-\x08\x0b\x0c\x0e-\x1f]|[a-zäöüß][A-Z0-9/][a-zäöüß]|/')) AS n_broken, count(*) AS n
FROM (SELECT doc_id, unnest(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS t FROM fx_damaged) GROUP BY doc_id""")
def broken_tokens(spark, d):
    t = X.damaged(spark, d).select("doc_id", F.explode(F.regexp_extract_all("raw", F.lit(X.TOKEN), F.lit(0))).alias("t"))
    return t.groupBy("doc_id").agg(F.count_if(T.looks_broken(F.col("t"))).alias("n_broken"), F.count("*").alias("n"))


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """
SELECT doc_id, rect_id, '(' || CAST(round_even(x0 + 0.5, 0) AS BIGINT) || ', ' || CAST(round_even(y0 + 0.5, 0) AS BIGINT) || ', ' || CAST(round_even(x1 - 0.5, 0) AS BIGINT) || ', ' || CAST(round_even(y1 - 0.5, 0) AS BIGINT) || ')' AS shown FROM fx_rects""")
def bbox_text(spark, d):
    shown = T.fmt_bbox(F.col("x0") + 0.5, F.col("y0") + 0.5, F.col("x1") - 0.5, F.col("y1") - 0.5)
    return X.rects(X.words(spark, d)).select("doc_id", "rect_id", shown.alias("shown"))


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """
SELECT doc_id, rect_id, x0, greatest(y0, 100) AS y0, least(x1, 250) AS x1, least(y1, 500) AS y1 FROM fx_rects WHERE least(x1, 250) > x0 AND least(y1, 500) > greatest(y0, 100)""")
def clipped_boxes(spark, d):
    box = T.clip(tuple(F.col(c) for c in ("x0", "y0", "x1", "y1")), tuple(F.lit(float(v)) for v in (0, 100, 250, 500)))
    return X.rects(X.words(spark, d)).select("doc_id", "rect_id", box.alias("b")).filter("b IS NOT NULL").select("doc_id", "rect_id", "b.*")


@query(both(X.SQL_WORDS, X.SQL_RECTS) + """
SELECT doc_id, rect_id, n, x0, y0, CASE WHEN color = 'red' OR n = 0 THEN x1 ELSE x1 + 3 END AS x1, y1 FROM fx_rects, (VALUES (0), (1)) v(n) WHERE n = 0 OR color <> 'red'""")
def drawn_paths(spark, d):
    """A path of one rect and three lines round a wider box; red ones have no items and count as they are."""
    named = lambda k, a, b, c, e: F.struct(F.lit(k).alias("kind"), a.alias("x0"), b.alias("y0"), c.alias("x1"), e.alias("y1"))
    x0, y0, x1, y1, wide = F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("x1") + 3
    items = F.array(named("re", x0, y0, x1, y1), named("l", x0, y0, wide, y0), named("l", wide, y0, wide, y1), named("l", wide, y1, x0, y1))
    some = F.when(F.col("color") == "red", F.filter(items, lambda i: F.lit(False))).otherwise(items)
    own = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return X.rects(X.words(spark, d)).select("doc_id", "rect_id", F.posexplode(G.path_rects(some, own)).alias("n", "r")).select("doc_id", "rect_id", "n", "r.x0", "r.y0", "r.x1", "r.y1")


FAILED = """SELECT o_custkey AS seq, o_orderkey AS scan_pos, CASE WHEN o_orderkey % 3 = 0 THEN 'no_candidate_windows' ELSE 'no_fuzzy_match' END AS reason,
 CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey * 7919 % 97) / CAST(100 AS DOUBLE) END AS best_score FROM orders"""


@query(f"""
SELECT seq, reason, top AS best_score FROM (SELECT *, max(best_score) OVER (PARTITION BY seq) AS top,
  row_number() OVER (PARTITION BY seq ORDER BY best_score DESC NULLS LAST, (reason <> 'no_candidate_windows') DESC, scan_pos) AS n FROM ({FAILED})) WHERE n = 1""")
def failure_merge(spark, d):
    s = F.expr("CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey * 7919 % 97) / 100D END")
    f = X.table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("scan_pos"), F.when(F.col("o_orderkey") % 3 == 0, "no_candidate_windows").otherwise("no_fuzzy_match").alias("reason"), s.alias("best_score"))
    return outputs.merged_failure(f, ["seq"])


@query("""
WITH m AS (SELECT l_orderkey AS doc_id, CASE WHEN l_partkey % 11 = 0 THEN '../x' ELSE 'a/' || (l_partkey % 30) END AS name, CAST(l_quantity AS BIGINT) * 2200000 AS size FROM lineitem),
e AS (SELECT *, CASE WHEN starts_with(name, '..') THEN 'parts' WHEN size > 104857600 THEN 'member_size' END AS e FROM m),
n AS (SELECT doc_id, name, count(*) AS n, sum(size) AS size, min(e) AS e FROM e GROUP BY ALL)
SELECT doc_id, coalesce(min(e), CASE WHEN max(n) > 1 THEN 'duplicate' END, CASE WHEN sum(size) > 524288000 THEN 'total_size' END) AS error FROM n GROUP BY doc_id""")
def archive_checks(spark, d):
    name = F.when(F.col("l_partkey") % 11 == 0, "../x").otherwise(F.concat(F.lit("a/"), F.col("l_partkey") % 30))
    m = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), name.alias("name"), (F.col("l_quantity").cast("long") * 2200000).alias("size"))
    return outputs.archive_errors(m)


@query("""
WITH t AS (SELECT DISTINCT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
n AS (SELECT doc_id, count(*) FILTER (WHERE quality = 0) AS a, count(*) FILTER (WHERE toxic = 1) AS b,
  string_agg('{"doc":' || doc_id || ',"toxic":' || toxic || '}', ',' ORDER BY toxic) FILTER (WHERE quality = 0) AS u,
  string_agg('{"word":"w' || quality || '","context":"c","reason":"ligature_unresolved"}', ',' ORDER BY quality) FILTER (WHERE toxic = 1) AS w FROM t GROUP BY doc_id)
SELECT doc_id, CASE WHEN a + b > 0 THEN 'needs_review' ELSE 'final' END AS status,
 '{"status":"' || CASE WHEN a + b > 0 THEN 'needs_review' ELSE 'final' END || '","requires_review":' || (a + b > 0) || ',"original":"o' || doc_id || '","marked":"m","output":"out","output_format":"pdf","notes_out":null,"unmatched_out":'
 || CASE WHEN a > 0 THEN '"u.json"' ELSE 'null' END || ',"unmatched_count":' || a || ',"unmatched":[' || coalesce(u, '') || '],"unresolved_count":' || b || ',"unresolved":[' || coalesce(w, '') || ']}' AS bundle FROM n""")
def review_bundles(spark, d):
    t = X.table(spark, d, "labels").dropna(subset=["quality", "toxic"]).select("doc_id", "quality", "toxic").distinct()
    text = lambda x: F.lit(x).cast("string")
    names = t.select("doc_id").distinct().select("doc_id", F.concat(F.lit("o"), F.col("doc_id")).alias("original"), text("m").alias("marked"), text("out").alias("output"), text("pdf").alias("output_format"), text(None).alias("notes_out"), text("u.json").alias("unmatched_out"))
    unmatched = t.filter("quality = 0").select("doc_id", F.col("toxic").alias("seq"), F.to_json(F.struct(F.col("doc_id").alias("doc"), "toxic")).alias("entry"))
    unresolved = t.filter("toxic = 1").select("doc_id", F.concat(F.lit("w"), F.col("quality")).alias("word"), F.lit("c").alias("context"))
    return outputs.review_bundle(names, unmatched, unresolved)


@query("""
WITH e AS (SELECT conv_id AS doc_id, turn AS seq, turn // 3 AS page_no, replace(text, chr(10), ' ') AS text, CASE WHEN turn % 2 = 0 THEN 'yellow' ELSE 'pink' END AS color, turn % 5 = 4 AS is_image FROM conversations),
l AS (SELECT *, CASE WHEN is_image THEN '- [image highlight, ' || color || ', bbox=(1, 2, 3, 4)]' ELSE '> ' || text || CASE WHEN color <> 'yellow' THEN ' _(' || color || ')_' ELSE '' END END AS line FROM e),
p AS (SELECT doc_id, page_no, '## Page ' || (page_no + 1) || chr(10) || chr(10) || string_agg(line, chr(10) || chr(10) ORDER BY seq, line) || chr(10) AS part FROM l GROUP BY doc_id, page_no)
SELECT doc_id, '# Highlights: t' || doc_id || chr(10) || chr(10) || string_agg(part, chr(10) ORDER BY page_no) AS markdown FROM p GROUP BY doc_id""")
def page_notes(spark, d):
    c = X.table(spark, d, "conversations")
    box = [F.lit(float(v)).alias(n) for n, v in (("x0", 1), ("y0", 2), ("x1", 3), ("y1", 4))]
    h = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("seq"), F.expr("turn div 3").alias("page_no"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"), F.when(F.col("turn") % 2 == 0, "yellow").otherwise("pink").alias("color"), (F.col("turn") % 5 == 4).alias("is_image"), *box)
    return outputs.page_notes(h, titles=c.select(F.col("conv_id").alias("doc_id")).distinct().withColumn("title", F.concat(F.lit("t"), F.col("doc_id"))))


@query()
def extract_all(spark, d):
    """Every highlight of every document in order, pictures too."""
    return marks.in_order(marks.marked_units(X.units(spark, d)))


@query()
def annotate_pages(spark, d):
    """Benchmark passages and unmarked boxes as annotations of the documents that hold them."""
    from spanloom.operators.annotate import annotate

    docs, w = X.table(spark, d, "documents"), X.words(spark, d)
    needles = X.table(spark, d, "benchmark").select(F.col("item_id").alias("seq"), "text")
    found = locate_exact(needles, docs).select("doc_id", "seq").join(F.broadcast(needles), "seq")
    r = X.rects(w)
    none, box = F.lit(""), [F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")]
    h = found.select("doc_id", "seq", F.lit(0).cast("long").alias("page_no"), F.lit("green").alias("color"), F.lit(False).alias("is_image"), "text", F.col("text").alias("raw_text"), none.alias("context_before"), none.alias("context_after"), *box)
    some = marks.image_highlights(r, marks.word_rect_hits(w, r)).join(found.select("doc_id").distinct(), "doc_id", "left_semi")
    i = some.select("doc_id", (1000 + F.xxhash64("page_no", "color", "passage") % 1000).alias("seq"), "page_no", "color", F.lit(True).alias("is_image"), none.alias("text"), none.alias("raw_text"), none.alias("context_before"), none.alias("context_after"), "x0", "y0", "x1", "y1")
    pages = w.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(595.0).alias("width"), F.lit(700.0).alias("height"))
    out = annotate(h.unionByName(i), w.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), pages)
    return out.withColumn("quads", F.to_json("quads"))
