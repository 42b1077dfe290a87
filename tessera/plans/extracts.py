"""Pieces taken out of whole texts: numbered items, questions, solutions, markup items, stray commands, damaged texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scan
from ..functions import splitters as S
from ..functions.damage import damaged
from .registry import query


def marked_lines(read):
    """The lines of documents, some with the heads of items, questions, solutions and sections before them."""
    place, line = F.col("place"), F.col("line")
    text = (
        F.when(place % 4 == 0, F.concat(F.expr("place div 4 + 1"), F.lit(". "), line))
        .when(place % 7 == 3, F.concat((F.col("doc_id") + place) % 60, F.lit("번 "), line))
        .when(place % 9 == 5, F.concat(F.lit("[해설 "), place % 5 + 1, F.lit("] [정답] "), line))
        .when((place == 2) & (F.col("doc_id") % 3 == 0), F.lit("[정답 및 해설]"))
        .otherwise(line)
    )
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.select("doc_id", "place", text.alias("text"))


def _by_text(read):
    return marked_lines(read).asTable().partitionBy("doc_id").orderBy("place")


@query()
def numbered_items(read):
    """Numbered items of each document: heads of a longest non-decreasing run of numbers."""
    return S.NumberedItems(_by_text(read))


@query()
def split_questions(read):
    """Questions of each document: heads of a longest run of numbers that go up by one."""
    return S.Questions(_by_text(read))


@query()
def solved_problems(read):
    """Items with the longest solution of their number, from the section of solutions or from marked ones."""
    return S.SolvedProblems(_by_text(read))


MARKED = """SELECT doc_id, string_agg(CASE WHEN place % 4 = 0 THEN concat(place // 4 + 1, '. ', line) WHEN place % 7 = 3 THEN concat((doc_id + place) % 60, '번 ', line) WHEN place % 9 = 5 THEN concat('[해설 ', place % 5 + 1, '] [정답] ', line)
    WHEN place = 2 AND doc_id % 3 = 0 THEN '[정답 및 해설]' ELSE line END, chr(10) ORDER BY place) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents) GROUP BY 1"""


def _marked_texts(read):
    lines = marked_lines(read).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("s"))
    return lines.select("doc_id", F.array_join("s.text", "\n").alias("t"))


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS place, CAST(n[i] AS INTEGER) AS number, sha1(regexp_replace(p[i + 1], '^\\s+|\\s+$', '', 'g')) AS digest FROM
(SELECT doc_id, regexp_extract_all(t, '\\[해설\\s*(\\d{{1,3}})\\]', 1) AS n, regexp_split_to_array(t, '\\[해설\\s*\\d{{1,3}}\\]') AS p FROM ({MARKED})), range(1, 100000) AS x(i) WHERE i <= len(n) AND CAST(n[i] AS INTEGER) BETWEEN 1 AND 100""")
def marked_solutions(read):
    """Solutions by the marks that name their numbers, up to the next mark."""
    head = r"\[해설\s*(\d{1,3})\]"
    texts = _marked_texts(read).select("doc_id", F.regexp_extract_all("t", F.lit(head), F.lit(1)).alias("n"), F.split("t", head).alias("p"))
    pieces = texts.select("doc_id", F.posexplode("n").alias("i", "number"), F.expr("slice(p, 2, size(p))").alias("p"))
    piece = F.regexp_replace(F.get("p", F.col("i")), r"^\s+|\s+$", "")
    return pieces.select("doc_id", (F.col("i") + 1).alias("place"), F.col("number").cast("int").alias("number"), F.sha1(piece).alias("digest")).where("number BETWEEN 1 AND 100")


@query(f"""SELECT doc_id, CASE WHEN h = '' THEN NULL ELSE CAST(length(t) - length(b) AS INTEGER) END AS solutions_chars, sha1(b) AS problems FROM
(SELECT doc_id, t, h, CASE WHEN h = '' THEN t ELSE substr(t, 1, strpos(t, h) - 1) END AS b FROM (SELECT doc_id, t, regexp_extract(t, '(?:^|\\n)[ \\t\\n]*(?:\\[정답\\s*및\\s*해설\\]|\\[해설\\]|정답\\s*및\\s*해설|해설)[ \\t]*\\n') AS h FROM ({MARKED})))""")
def solution_sections(read):
    """Texts cut at the first head of a section of solutions."""
    head = r"(?:^|\n)[ \t\n]*(?:\[정답\s*및\s*해설\]|\[해설\]|정답\s*및\s*해설|해설)[ \t]*\n"
    texts = _marked_texts(read).withColumn("b", F.split("t", head, 2))
    before = F.get("b", F.lit(0))
    return texts.select("doc_id", F.when(F.size("b") > 1, F.length("t") - F.length(before)).alias("solutions_chars"), F.sha1(before).alias("problems"))


HTML = [("<p>", "<CHAR>"), ("</p>", "</CHAR>"), ("<h1>", "<EQUATION><SCRIPT> "), ("</h1>", " </SCRIPT></EQUATION>"), ("<br>", "<PICTURE/>"), ("de", "&lt;de&amp;")]
NESTED = "html"
for _old, _new in HTML:
    NESTED = f"replace({NESTED}, '{_old}', '{_new}')"


@query(f"""SELECT page_id, CAST(place - 1 AS INTEGER) AS place, CASE WHEN starts_with(m, '<CHAR') THEN 'T' WHEN starts_with(m, '<EQ') THEN 'E' ELSE 'P' END AS kind,
CASE WHEN starts_with(m, '<CHAR') THEN replace(replace(replace(replace(replace(regexp_extract(m, '>([^<]+)<', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&quot;', '"'), '&apos;', '''') WHEN starts_with(m, '<EQ') THEN regexp_replace(regexp_extract(m, '<SCRIPT>(.*?)</SCRIPT>', 1, 's'), '^\\s+|\\s+$', '', 'g') ELSE '[FIGURE]' END AS value
FROM (SELECT page_id, unnest(l) AS m, generate_subscripts(l, 1) AS place FROM (SELECT page_id, regexp_extract_all({NESTED}, '<CHAR[^>]*>[^<]+</CHAR>|<EQUATION[^>]*>.*?<SCRIPT>.*?</SCRIPT>.*?</EQUATION>|<PICTURE[^>]*>', 0, 's') AS l FROM pages))""")
def markup_items(read):
    """Pages as an ordered sequence of texts, formulas and pictures."""
    text = F.expr(NESTED)
    return read("pages").select("page_id", F.posexplode(markup.items(text)).alias("place", "item")).select("page_id", "place", "item.kind", "item.value")


#: Frequent words of the documents, and marks in their place.
MARKS = [(" de ", r" \\$ "), (" the ", " $x "), (" und ", r" \\frac "), (" que ", " ``` "), (" la ", r" \\begin{a} "), (" der ", r" $$\\alpha "), (" and ", r" \\, \\_ "), (" le ", r" \\\\$y ")]


@query()
def stray_commands(read):
    """Commands outside formulas and code, over documents with marks in place of frequent words."""
    text = "text"
    for old, new in MARKS:
        text = f"replace({text}, '{old}', '{new}')"
    hits = read("documents").select("doc_id", F.inline(scan.stray_commands(F.expr(text))))
    return hits.select("doc_id", "line", "match", "text")


SPACES = "[ \\t\\n\\x{0b}\\f\\r\\x{a0}\\x{3000}]"
BROKEN = "text"
for _old, _new in [(" de ", "①   "), (" the ", "  명"), (" la ", "$ $"), (" und ", "②  \\n"), (" and ", "=  가"), (" le ", "가  이다x"), (" que ", "  점")]:
    BROKEN = f"replace({BROKEN}, '{_old}', '{_new}')"
IN_DUCK = BROKEN.replace("'②  \\n'", "concat('②  ', chr(10))")


@query(f"""WITH t AS (SELECT doc_id, {IN_DUCK} AS t FROM documents), c AS (SELECT doc_id, length(t) AS n, len(regexp_extract_all(regexp_replace(t, '[①-⑩]', chr(1) || '①', 'g'), '①(?:{SPACES}{{2,}}\\n|{SPACES}{{2,}}(?:\\x{{01}}|$))')) AS a, len(regexp_extract_all(t, '{SPACES}{{2,}}[명원개점장번회배쪽]')) AS b,
len(regexp_extract_all(t, '\\${SPACES}*\\$|={SPACES}{{2,}}[가-힣]|[가-힣]{SPACES}{{2,}}이[다라]?\\b')) AS c, len(list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '^{SPACES}+|{SPACES}+$', '', 'g')) BETWEEN 1 AND 3)) AS d, len(string_split(t, chr(10))) AS lines FROM t)
SELECT doc_id, CAST(CASE WHEN a >= 3 THEN a ELSE 0 END + CASE WHEN b >= 3 THEN b ELSE 0 END + CASE WHEN c >= 5 THEN c ELSE 0 END + CASE WHEN d >= 10 AND d > 0.25 * lines THEN d ELSE 0 END AS INTEGER) AS hits,
CASE WHEN a >= 3 THEN a ELSE 0 END + CASE WHEN b >= 3 THEN b ELSE 0 END + CASE WHEN c >= 5 THEN c ELSE 0 END + CASE WHEN d >= 10 AND d > 0.25 * lines THEN d ELSE 0 END >= 6 * greatest(n / 1000, 1) AS broken FROM c""")
def damaged_texts(read):
    """Texts whose numbers and formulas got lost, by four counts and their share of the text."""
    return read("documents").select("doc_id", F.inline(F.array(damaged(F.expr(BROKEN)))))
