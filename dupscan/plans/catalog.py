"""Registered queries over the test tables and their DuckDB twins, each over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupscan.config import DetectionConfig
from dupscan.functions import text as T
from dupscan.operators import clones, similarity, stats, syntax
from dupscan.plans.detector import detect, total_clones
from dupscan.sources import files as S

WIDTH, MIN_LINES = 50, 2
EXTENSIONS = ["py", "js", "tsx", "rs", "java", "go", "c", "cc", "hpp", "txt"]
SAMPLES = ["src/a.py", ".git/x.py", "pkg/build/b.py", "pkg/.hidden.py", "lib/__init__.py", "Makefile", "node_modules/m/i.js", "pkg/mod.pyi"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), F.col("lang").alias("language"))


def spread(files: DataFrame) -> DataFrame:
    """Lexing is the costly part and files are few and large: rows are spread before it."""
    return files.repartition(max(16, files.sparkSession.sparkContext.defaultParallelism * 4))


def document_arrays(spark: SparkSession, sf_dir: str, mask: bool = False) -> DataFrame:
    return clones.text_arrays(spread(document_files(spark, sf_dir).select("file_id", "content")), mask)


SOLID, ALL = T.SOLID, T.TOKEN
DOCS = "docs AS (SELECT doc_id AS file_id, source || '/' || doc_id AS path, coalesce(text, '') AS content, lang AS language FROM documents)"
TOKENS = f"toks AS (SELECT file_id, regexp_extract_all(lower(content), '{SOLID}') AS k FROM docs)"
WINDOWS = f"wins AS (SELECT file_id, unnest(range(0, len(k) - {WIDTH} + 1)) AS pos, unnest(list_transform(range(0, len(k) - {WIDTH} + 1), lambda i: md5(array_to_string(k[i + 1:i + {WIDTH}], ' ')))) AS sig FROM toks WHERE len(k) >= {WIDTH})"
REPEATED = "reps AS (SELECT * FROM wins WHERE sig IN (SELECT sig FROM wins GROUP BY sig HAVING count(*) > 1))"
#: Positions of the tokens that are not white space.
PLACES = f"""
pieces AS (SELECT file_id, unnest(t) AS value, generate_subscripts(t, 1) AS i FROM (SELECT file_id, regexp_extract_all(lower(content), '{ALL}') AS t FROM docs)),
placed AS (SELECT file_id, i, value, length(value) - length(replace(value, chr(10), '')) AS breaks,
  coalesce(sum(length(value)) OVER w, 0)::BIGINT AS start,
  1 + coalesce(sum(length(value) - length(replace(value, chr(10), ''))) OVER w, 0)::BIGINT AS start_line
  FROM pieces WINDOW w AS (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (SELECT file_id, start, start + length(value) AS "end", start_line, start_line + breaks AS end_line,
  row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS pos
  FROM placed WHERE NOT regexp_matches(value, '^[{T.SPACE}]')),
spots AS (SELECT r.file_id, r.pos, r.sig, a.start, b."end", a.start_line, b.end_line
  FROM reps r JOIN kept a ON a.file_id = r.file_id AND a.pos = r.pos
  JOIN kept b ON b.file_id = r.file_id AND b.pos = r.pos + {WIDTH - 1}),
tall AS (SELECT * FROM spots WHERE end_line - start_line + 1 >= {MIN_LINES}),
good AS (SELECT * FROM tall WHERE sig IN (SELECT sig FROM tall GROUP BY sig HAVING count(*) > 1))"""
LINES = "(CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END)::BIGINT"


@query(f"""WITH {DOCS}, each AS (SELECT language, count(*) AS n, sum(strlen(content)) AS b, sum({LINES}) AS l FROM docs GROUP BY language)
SELECT sum(n)::BIGINT AS total_files, sum(b)::BIGINT AS total_bytes, sum(l)::BIGINT AS total_lines,
string_agg(language || ':' || n, ',' ORDER BY language) AS by_language FROM each""")
def source_stats(spark, sf_dir):
    row = stats.file_statistics(document_files(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("by_language"), lambda e: F.concat(e.key, F.lit(":"), e.value.cast("string"))))
    return row.withColumn("by_language", F.array_join(entries, ","))


@query(f"WITH {DOCS} SELECT language, count(*) AS files, sum(strlen(content))::BIGINT AS bytes, sum({LINES})::BIGINT AS lines FROM docs GROUP BY language")
def stats_by_language(spark, sf_dir):
    return stats.by_language(document_files(spark, sf_dir))


@query(f"WITH {DOCS} SELECT file_id, path, {LINES} AS lines FROM docs WHERE language = 'fr'")
def language_filter(spark, sf_dir):
    return S.with_language(document_files(spark, sf_dir), "fr").select("file_id", "path", T.text_lines(F.col("content")).alias("lines"))


CASES = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in S.LANGUAGES.items())


@query(f"""WITH named AS (SELECT doc_id, source || '/f' || doc_id || '.' || ([{", ".join(f"'{e}'" for e in EXTENSIONS)}])[1 + doc_id % {len(EXTENSIONS)}] AS path FROM documents)
SELECT doc_id, path, regexp_extract(path, '[.]([^./]*)$', 1) AS extension,
CASE regexp_extract(path, '[.]([^./]*)$', 1) {CASES} ELSE 'unknown' END AS language FROM named""")
def detect_language(spark, sf_dir):
    ends = F.array(*map(F.lit, EXTENSIONS))
    path = F.concat(F.col("source"), F.lit("/f"), F.col("doc_id").cast("string"), F.lit("."), F.get(ends, (F.col("doc_id") % len(EXTENSIONS)).cast("int")))
    named = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return named.select("doc_id", "path", S.extension(F.col("path")).alias("extension"), S.language_of(F.col("path")).alias("language"))


SKIP = ", ".join(f"'{s}'" for s in S.SKIPPED)


@query(f"""WITH named AS (SELECT doc_id, ([{", ".join(f"'{s}'" for s in SAMPLES)}])[1 + doc_id % {len(SAMPLES)}] AS path FROM documents),
split AS (SELECT doc_id, path, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM named)
SELECT doc_id, path, starts_with(name, '.') AS hidden, name IN ({SKIP}) AS skipped,
regexp_matches(name, '^.+[.]py$') AS included,
len(list_filter(parts, lambda c: starts_with(c, '.') OR c IN ({SKIP}))) = 0 AS reachable FROM split""")
def path_filters(spark, sf_dir):
    names = F.array(*map(F.lit, SAMPLES))
    path = F.col("path")
    named = table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % len(SAMPLES)).cast("int")).alias("path"))
    return named.select("doc_id", "path", S.is_hidden(path).alias("hidden"), S.is_skipped(path).alias("skipped"), S.included(path, ["py"]).alias("included"), S.reachable(path).alias("reachable"))


def _count(test: str) -> str:
    return f"len(list_filter(t, lambda v: {test}))::BIGINT"


@query(f"""WITH {DOCS}, lexed AS (SELECT file_id, regexp_extract_all(content, '{ALL}') AS t FROM docs)
SELECT file_id, len(t)::BIGINT AS tokens, {_count("regexp_matches(v, '^[\\p{L}_]')")} AS identifiers, {_count("regexp_matches(v, '^[0-9]')")} AS literals,
{_count(f"regexp_matches(v, '^[{T.SPACE}]')")} AS spaces, {_count(f"NOT regexp_matches(v, '^[{T.SPACE}]')")} AS significant FROM lexed""")
def lex_counts(spark, sf_dir):
    kinds = lambda v: F.substring(T.token_class(v), 1, 1)
    lexed = spread(document_files(spark, sf_dir).select("file_id", "content")).select("file_id", F.array_join(F.transform(T.all_tokens(F.col("content")), kinds), "").alias("c"))
    n = lambda kind: (F.length("c") - F.length(F.replace(F.col("c"), F.lit(kind), F.lit("")))).cast("long")
    return lexed.select("file_id", F.length("c").cast("long").alias("tokens"), n("I").alias("identifiers"), n("L").alias("literals"), n("W").alias("spaces"), (F.length("c") - n("W")).cast("long").alias("significant"))


MASKED = "list_transform(k, lambda v: CASE WHEN regexp_matches(v, '^[\\p{L}_]') THEN '$ID' WHEN regexp_matches(v, '^[0-9]') THEN '$LIT' ELSE v END)"


@query(f"WITH {DOCS}, {TOKENS} SELECT file_id, len(k)::BIGINT AS tokens, md5(array_to_string({MASKED}, ' ')) AS fingerprint FROM toks")
def normalized_fingerprint(spark, sf_dir):
    a = document_arrays(spark, sf_dir, mask=True)
    return a.select("file_id", F.size("norm").cast("long").alias("tokens"), F.md5(T.normalized_string(F.col("norm"))).alias("fingerprint"))


@query(f"""WITH {DOCS}, {TOKENS},
h AS (SELECT file_id, len(k) AS n, unnest(list_transform(k, lambda v: ('0x' || substr(md5(v), 1, 15))::BIGINT % {T.MODULUS})) AS t, generate_subscripts(k, 1) - 1 AS i FROM toks WHERE len(k) >= {WIDTH}),
p AS (SELECT j, list_reduce(list_prepend(1::BIGINT, list_transform(range({WIDTH} - 1 - j), lambda x: {T.BASE}::BIGINT)), lambda a, b: (a * b) % {T.MODULUS}) AS power FROM range({WIDTH}) AS r(j)),
rolled AS (SELECT file_id, i - j AS pos, sum((t * power) % {T.MODULUS})::BIGINT % {T.MODULUS} AS r FROM h, p WHERE i >= j AND i - j <= n - {WIDTH} GROUP BY file_id, i - j)
SELECT file_id, count(*) AS windows, count(DISTINCT r) AS values, sum(r)::BIGINT AS total, max(pos * (r % 1000))::BIGINT AS placed FROM rolled GROUP BY file_id""")
def rolling_hash(spark, sf_dir):
    """Of the rolling hashes of all windows of a document: how many, how many distinct ones, their sum, and a figure that
    depends on their order."""
    a = document_arrays(spark, sf_dir).where(F.size("norm") >= WIDTH)
    rows = a.select("file_id", F.posexplode(T.rolling_hashes(F.col("norm"), WIDTH)).alias("pos", "r"))
    return rows.groupBy("file_id").agg(F.count("*").alias("windows"), F.count_distinct("r").alias("values"), F.sum("r").alias("total"), F.max(F.col("pos") * (F.col("r") % 1000)).alias("placed"))


@query(f"WITH {DOCS}, {TOKENS} SELECT md5(array_to_string(k, ' ')) AS fingerprint, count(*) AS n, min(file_id) AS first_file FROM toks GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return clones.exact_duplicates(document_arrays(spark, sf_dir))


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}
SELECT sig, count(*) AS n, count(DISTINCT file_id) AS n_files, min((file_id, pos))[1] AS first_file, min((file_id, pos))[2] AS first_pos FROM wins GROUP BY sig HAVING count(*) > 1""")
def window_candidates(spark, sf_dir):
    return clones.candidates(clones.windows(document_arrays(spark, sf_dir), WIDTH))


def _located(spark, sf_dir):
    """Repeated 50-token windows of the documents with positions, of MIN_LINES lines or more."""
    files = document_files(spark, sf_dir)
    return files, clones.repeated(clones.text_windows(spread(files.select("file_id", "content")), WIDTH, min_lines=MIN_LINES))


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {PLACES}
SELECT sig, 'Type-1' AS clone_type, 1.0::DOUBLE AS similarity, count(*) AS size, sum(end_line - start_line + 1)::DOUBLE / count(*) AS avg_lines FROM good GROUP BY sig""")
def clone_groups(spark, sf_dir):
    return clones.groups(_located(spark, sf_dir)[1])


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {PLACES}
SELECT g.sig, g.file_id, d.path, g.pos::BIGINT AS pos, g.start_line::BIGINT AS start_line, g.end_line::BIGINT AS end_line, md5(substr(d.content, g.start::BIGINT + 1, (g."end" - g.start)::BIGINT)) AS content_md5 FROM good g JOIN docs d USING (file_id)""")
def clone_instances(spark, sf_dir):
    files, rows = _located(spark, sf_dir)
    out = clones.instances(rows, files)
    return out.select("sig", "file_id", "path", F.col("pos").cast("long").alias("pos"), F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.md5("content").alias("content_md5"))


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {PLACES} SELECT count(DISTINCT sig) AS groups, count(*) AS instances FROM good""")
def total_clone_count(spark, sf_dir):
    return total_clones(clones.groups(_located(spark, sf_dir)[1]))


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED},
pairs AS (SELECT lag(file_id) OVER o AS file_a, lag(pos) OVER o AS pos_a, file_id AS file_b, pos AS pos_b FROM reps WINDOW o AS (PARTITION BY sig ORDER BY file_id, pos)),
steps AS (SELECT *, pos_b - pos_a AS diagonal, coalesce(pos_a > lag(pos_a) OVER (PARTITION BY file_a, file_b, pos_b - pos_a ORDER BY pos_a) + {WIDTH}, true)::INT AS opens FROM pairs WHERE file_a IS NOT NULL),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY file_a, file_b, diagonal ORDER BY pos_a) AS island FROM steps),
found AS (SELECT file_a, min(pos_a) AS pos_a, file_b, min(pos_b) AS pos_b, max(pos_a) - min(pos_a) + {WIDTH} AS length FROM runs GROUP BY file_a, file_b, diagonal, island)
SELECT *, file_a = file_b AND pos_b < pos_a + length AS overlaps FROM found""")
def clone_regions(spark, sf_dir):
    return clones.regions(clones.repeated(clones.windows(document_arrays(spark, sf_dir), WIDTH)), WIDTH)


#: All pairs of distinct token sequences that share a window, from the definition.
SHARING = """firsts AS (SELECT min(file_id) AS file_id FROM toks GROUP BY array_to_string(k, ' ')),
owners AS (SELECT DISTINCT sig, file_id FROM reps JOIN firsts USING (file_id)),
pairs AS (SELECT DISTINCT a.file_id AS file_a, b.file_id AS file_b FROM owners a JOIN owners b ON a.sig = b.sig AND a.file_id < b.file_id),
sets AS (SELECT file_id, list_distinct(k) AS s FROM toks),
scored AS (SELECT file_a, file_b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM pairs JOIN sets a ON a.file_id = file_a JOIN sets b ON b.file_id = file_b),
alike AS (SELECT file_a, file_b, i::DOUBLE / (n - i) AS similarity FROM scored)"""


def _similar(spark, sf_dir, threshold, edits=False):
    found = similarity.near_files(document_files(spark, sf_dir), WIDTH, threshold, edits)
    return found.withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {SHARING} SELECT file_a, file_b, round(similarity, 9) AS similarity FROM alike WHERE similarity >= 0.7")
def jaccard_pairs(spark, sf_dir):
    return _similar(spark, sf_dir, 0.7)


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {SHARING}
SELECT file_a, file_b, round(similarity, 9) AS similarity, 'Type-3' AS clone_type FROM alike WHERE similarity >= 0.85""")
def similar_documents(spark, sf_dir):
    return _similar(spark, sf_dir, 0.85).withColumn("clone_type", F.lit("Type-3"))


@query()
def levenshtein_pairs(spark, sf_dir):
    """Edit similarity, in characters, of the normalised texts of similar_documents' pairs.  DuckDB's levenshtein counts
    bytes, so there is no SQL; the tests use brute force."""
    return _similar(spark, sf_dir, 0.85, edits=True)


@query(f"""WITH turns AS (SELECT conv_id, turn, unnest(string_split(lower(coalesce(text, '')), chr(10))) AS line FROM conversations)
SELECT md5(array_to_string(regexp_extract_all(line, '{SOLID}'), ' ')) AS sig, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM turns GROUP BY 1 HAVING count(*) > 1""")
def repeated_conversations(spark, sf_dir):
    """Lines that occur more than once in the turns of conversations."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("content"))
    prints = clones.text_arrays(rows).select("file_id", T.fingerprint(F.col("norm")).alias("sig"))
    return prints.groupBy("sig").agg(F.count("*").alias("n"), F.countDistinct("file_id").alias("conversations")).where("n > 1")


@query(f"""WITH docs AS (SELECT page_id AS file_id, coalesce(html, '') AS content FROM pages), {TOKENS}, {WINDOWS}
SELECT sig, count(*) AS n, count(DISTINCT file_id) AS n_files, min((file_id, pos))[1] AS first_file, min((file_id, pos))[2] AS first_pos FROM wins GROUP BY sig HAVING count(*) > 1""")
def page_windows(spark, sf_dir):
    files = S.collect_table(table(spark, sf_dir, "pages"), "page_id", "html", "text")
    return clones.candidates(clones.windows(clones.text_arrays(spread(files.select("file_id", "content"))), WIDTH))


OVERLAP = 10


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{SOLID}') AS k FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{SOLID}') AS k FROM benchmark),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, len(k) - {OVERLAP} + 1), lambda i: md5(array_to_string(k[i + 1:i + {OVERLAP}], ' ')))) AS sig FROM d WHERE len(k) >= {OVERLAP}),
bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(0, len(k) - {OVERLAP} + 1), lambda i: md5(array_to_string(k[i + 1:i + {OVERLAP}], ' ')))) AS sig FROM b WHERE len(k) >= {OVERLAP})
SELECT doc_id, item_id, count(*) AS shared FROM dw JOIN bw USING (sig) GROUP BY doc_id, item_id""")
def benchmark_overlap(spark, sf_dir):
    docs = clones.windows(document_arrays(spark, sf_dir), OVERLAP).select(F.col("file_id").alias("doc_id"), "sig")
    items = S.collect_table(table(spark, sf_dir, "benchmark"), "item_id", "text", "text")
    seeds = clones.windows(clones.text_arrays(items), OVERLAP).select(F.col("file_id").alias("item_id"), "sig").distinct()
    return docs.join(seeds, "sig").distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query(f"""WITH {DOCS} SELECT file_id, CASE WHEN len(string_split(content, chr(10))) > 3 THEN array_to_string(string_split(content, chr(10))[1:3], chr(10)) || chr(10) || '...' ELSE content END AS preview FROM docs""")
def content_preview(spark, sf_dir):
    return document_files(spark, sf_dir).select("file_id", T.preview(F.col("content")).alias("preview"))


@query(f"""WITH {DOCS}, {TOKENS}, {WINDOWS}, {REPEATED}, {PLACES}
SELECT '{{"signature":"' || sig || '","clone_type":"Type-1","size":' || count(*) || ',"instances":[' || string_agg(file_id || ':' || start_line || '-' || end_line, ',' ORDER BY file_id, pos) || ']}}' AS line FROM good GROUP BY sig""")
def report_json(spark, sf_dir):
    rows = _located(spark, sf_dir)[1]
    places = F.transform(F.array_sort(F.collect_list(F.struct("file_id", "pos", "start_line", "end_line"))), lambda x: F.concat(x.file_id.cast("string"), F.lit(":"), x.start_line.cast("string"), F.lit("-"), x.end_line.cast("string")))
    one = rows.groupBy("sig").agg(F.count("*").alias("size"), F.array_join(places, ",").alias("at"))
    return one.select(F.format_string('{"signature":"%s","clone_type":"Type-1","size":%d,"instances":[%s]}', "sig", "size", "at").alias("line"))


TEXT_MASK = f"list_transform(k, lambda v: CASE WHEN regexp_matches(v, '^[\\p{{L}}_]') THEN '$ID' WHEN regexp_matches(v, '^[0-9]') THEN '$LIT' ELSE v END)"


@query(f"""WITH docs AS (SELECT item_id AS file_id, coalesce(text, '') || chr(10) AS content FROM benchmark),
toks AS (SELECT file_id, regexp_extract_all(content, '{SOLID}') AS k FROM docs),
both_ AS (SELECT file_id, k, {TEXT_MASK} AS m FROM toks WHERE len(k) >= 12),
wins AS (SELECT file_id, unnest(list_transform(range(0, len(k) - 11), lambda i: md5(array_to_string(m[i + 1:i + 12], ' ')))) AS sig,
  unnest(list_transform(range(0, len(k) - 11), lambda i: md5(array_to_string(k[i + 1:i + 12], ' ')))) AS raw FROM both_)
SELECT sig, CASE WHEN min(raw) = max(raw) THEN 'Type-1' ELSE 'Type-2' END AS clone_type, 1.0::DOUBLE AS similarity, count(*) AS size FROM wins GROUP BY sig HAVING count(*) > 1""")
def detected_groups(spark, sf_dir):
    """detect() with masking over the benchmark's texts, windows of 12 tokens: groups of Type-1 and Type-2."""
    files = S.collect_table(table(spark, sf_dir, "benchmark").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"))), "item_id", "text", "text")
    return detect(files, DetectionConfig(min_tokens=12, min_lines=1, whole_units=False)).groups.select("sig", "clone_type", "similarity", "size")


PYTHON = [
    "def total(values):\n    result = 0\n    for value in values:\n        result += value\n    return result\n",
    "def add_all(numbers):\n    # the same with other names\n    acc = 0\n    for n in numbers:\n        acc += n\n    return acc\n",
    "def greet(name):\n    return f'hello {name}'\n",
]


def python_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"f{i}.py", s, "python") for i, s in enumerate(PYTHON)], S.FILES)


@query()
def python_clones(spark, sf_dir):
    """Renamed copies among the inlined sources."""
    return detect(python_files(spark), DetectionConfig(min_tokens=10, min_lines=2)).groups


@query()
def python_subtrees(spark, sf_dir):
    """Equal subtrees among the inlined sources."""
    return syntax.subtree_groups(syntax.python_nodes(python_files(spark)), min_size=4)
