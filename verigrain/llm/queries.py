"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verigrain.llm.exact_dedup import exact_dedup
from verigrain.llm.fingerprints import fingerprints_with_groups
from verigrain.llm.langid import identify_language, train_language_model
from verigrain.llm.licenses import scan_licenses
from verigrain.llm.line_dedup import line_dedup
from verigrain.llm.mixing import mix_sources
from verigrain.llm.ngram_join import ngram_jaccard_join
from verigrain.llm.packing import pack_documents
from verigrain.llm.phrases import mine_phrases
from verigrain.llm.quality import classify_quality, train_quality_model
from verigrain.llm.sampling import crc_fold
from verigrain.llm.target_encoding import encode_lines
from verigrain.llm.token_files import token_files
from verigrain.llm.toxicity import classify_toxicity, train_toxicity_model

#: Production mix: target shares of characters. ``*`` is every source not named.
MIX_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05, "*": 0.55}
MIX_SEED = 20240131


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir), MIX_WEIGHTS, MIX_SEED)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir), digest_col="text_sha256")


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def _held_out(folds: int, held_out: int) -> Column:
    return F.coalesce(crc_fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify_quality(docs, model).select("doc_id", _held_out(3, 1), "score", "predicted")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_groups(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify_toxicity(docs, model).select("doc_id", _held_out(3, 1), "score", "predicted")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train_language_model(docs, crc_fold("doc_id", 4) != 2)
    return identify_language(docs.select("doc_id", "text"), model).select("doc_id", _held_out(4, 2), "lang_pred", "score", "ambiguous")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "text")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(documents(spark, sf_dir).select("lang", "text"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_target_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_lines(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("sale_lines", "sales", "items", "vendors", "clients")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pack_sequences": op2_pack_sequences,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_fingerprint": op6_fingerprint,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_join": op8_ngram_join,
    "op9_language_id": op9_language_id,
    "op10_line_dedup": op10_line_dedup,
    "op11_phrases": op11_phrases,
    "op12_token_files": op12_token_files,
    "op13_target_encoding": op13_target_encoding,
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_MIX_CASE = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in MIX_WEIGHTS.items())
_MIX_NAMED = ", ".join(f"'{k}'" for k in MIX_WEIGHTS if k != "*")

def _encoding_sql() -> str:
    """Counts are those of the key less those of the key in the own fold, each over frames of strictly earlier times."""
    keys = {"all": "0", "kind": "kind", "nation": "nation", "segment": "segment", "item": "item_id", "vendor": "vendor_id", "client": "client_id"}
    earlier = "ORDER BY sold_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING"
    counts = ", ".join(
        f"coalesce(sum({of}) OVER (PARTITION BY {key} {earlier}), 0) - coalesce(sum({of}) OVER (PARTITION BY {key}, fold {earlier}), 0) AS {name}_{c}"
        for name, key in keys.items() for c, of in (("n", "n_lines"), ("s", "n_returned"))
    )
    rate = lambda name, prior: f"CASE WHEN {name}_n < 1 THEN {prior} ELSE (1000000 * {name}_s + 50 * {prior}) // ({name}_n + 50) END"
    step = lambda names, prior: ", ".join(f"{rate(n, prior)} AS {n}_rate" for n in names)
    crc = "list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: " + _crc_step() + ")"
    return f"""
        WITH own AS (
          SELECT sale_id, coalesce(item_id, -1) AS item_id, vendor_id, count(*) AS n_lines, count(*) FILTER (flag = 'returned') AS n_returned
          FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY ALL),
        sold AS (SELECT sale_id, sold_at, coalesce(client_id, -1) AS client_id, xor({crc}, 4294967295::BIGINT) % 5 AS fold FROM sales WHERE sold_at IS NOT NULL),
        base AS (
          SELECT own.*, sold_at, client_id, fold, kind, nation, segment FROM own JOIN sold USING (sale_id)
          LEFT JOIN (SELECT item_id, min(kind) AS kind FROM items GROUP BY 1) USING (item_id)
          LEFT JOIN (SELECT vendor_id, min(nation_id) AS nation FROM vendors GROUP BY 1) USING (vendor_id)
          LEFT JOIN (SELECT client_id, min(segment) AS segment FROM clients GROUP BY 1) USING (client_id)),
        c AS (SELECT sale_id, item_id, vendor_id, n_lines, n_returned, {counts} FROM base),
        r0 AS (SELECT *, {step(["all"], "500000")} FROM c),
        r1 AS (SELECT *, {step(["kind", "nation", "segment"], "all_rate")} FROM r0)
        SELECT sale_id, item_id, vendor_id, n_lines, n_returned, item_n::BIGINT AS item_n, ({rate("item", "kind_rate")})::BIGINT AS item_rate,
               vendor_n::BIGINT AS vendor_n, ({rate("vendor", "nation_rate")})::BIGINT AS vendor_rate,
               client_n::BIGINT AS client_n, ({rate("client", "segment_rate")})::BIGINT AS client_rate
        FROM r1"""


def _crc_step() -> str:
    """One byte of crc32 (reflected polynomial 0xEDB88320), eight shifts written out."""
    x = "xor(a, b)"
    for _ in range(8):
        x = f"list_transform([{x}], lambda v: xor(v >> 1, (v & 1) * 3988292384))[1]"
    return x


ORACLES: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op1_mix_sources": f"""
        WITH RECURSIVE d AS (
          SELECT *, CASE WHEN source IN ({_MIX_NAMED}) THEN source ELSE '*' END AS grp FROM documents),
        sizes AS (SELECT grp, sum(length(coalesce(text, ''))) AS size FROM d GROUP BY grp),
        shares AS (SELECT grp, size, CASE grp {_MIX_CASE} END AS weight FROM sizes),
        rates AS (
          SELECT grp, CASE WHEN size > 0 THEN weight / (SELECT sum(weight ORDER BY grp) FROM shares WHERE size > 0)
                        * (SELECT sum(size) FROM sizes)::DOUBLE / size::DOUBLE ELSE 0 END AS rate FROM shares),
        cdf AS (
          SELECT grp, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
          UNION ALL
          SELECT grp, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf
          WHERE k < ceil(rate + 12 * sqrt(rate) + 40)),
        u AS (
          SELECT d.*, ('0x' || substr(md5('{MIX_SEED}|' || doc_id || '|1'), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM d),
        steps AS (SELECT grp, list(c ORDER BY k) AS cs FROM cdf GROUP BY grp),
        drawn AS (SELECT u.*, len(list_filter(cs, lambda c: c <= u)) AS n FROM u JOIN steps USING (grp))
        SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, n::INT AS n_copies,
               ('0x' || substr(md5('{MIX_SEED} order|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
        FROM drawn, LATERAL (SELECT unnest(range(1, n + 1)) AS copy)""",
    "op8_ngram_join": f"""
        WITH RECURSIVE d AS (
          SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
        sizes AS (SELECT doc_id, count(g) AS n FROM d LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
          FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
          SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
        reach AS (
          SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT doc_id, n::BIGINT AS n_shingles, component_id
        FROM sizes JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)""",
    "op10_line_dedup": """
        WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (
          SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM rows),
        folded AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\\x09\\x0b\\x0c\\x0d ]+', ' ', 'g'), ' ') AS f FROM lines),
        masked AS (
          SELECT doc_id, pos, string_split(m, ' ') AS toks, m FROM (
            SELECT doc_id, pos, regexp_replace(f, '[^ 0-9]*[0-9][^ ]*', '<*>', 'g') AS m FROM folded) WHERE m <> ''),
        slim AS (SELECT *, len(toks) || '|' || list_aggregate(toks[1:3], 'string_agg', ' ') AS leaf FROM masked),
        held AS (SELECT DISTINCT doc_id, leaf, m FROM slim),
        leaves AS (SELECT leaf FROM held GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10),
        cand AS (SELECT leaf, m, count(*) AS n_docs FROM held WHERE leaf IN (SELECT leaf FROM leaves) GROUP BY leaf, m),
        tokens AS (
          SELECT leaf, m, n_docs, unnest(string_split(m, ' ')) AS token,
                 generate_subscripts(string_split(m, ' '), 1) AS place FROM cand),
        fixed AS (SELECT leaf, place, token FROM tokens WHERE token <> '<*>' GROUP BY leaf, place, token HAVING sum(n_docs) >= 10),
        templates AS (
          SELECT t.leaf, t.m, string_agg(CASE WHEN f.token IS NULL THEN '<*>' ELSE t.token END, ' ' ORDER BY t.place) AS template
          FROM tokens t LEFT JOIN fixed f ON t.leaf = f.leaf AND t.place = f.place AND t.token = f.token
          GROUP BY t.leaf, t.m HAVING count(f.token) > 0 AND count(f.token) >= 0.8::DOUBLE * count(*) FILTER (t.token <> '<*>')),
        placed AS (SELECT doc_id, pos, leaf, template FROM slim JOIN templates USING (leaf, m)),
        recurring AS (
          SELECT leaf, template, min((doc_id, pos)) AS first FROM placed
          GROUP BY leaf, template HAVING count(DISTINCT doc_id) >= 10),
        gone AS (
          SELECT DISTINCT doc_id, pos FROM placed JOIN recurring USING (leaf, template) WHERE (doc_id, pos) <> first),
        kept AS (
          SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS text, count(g.pos) AS n_dropped
          FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
        SELECT r.doc_id, CASE WHEN r.text = '' THEN 0 ELSE len(string_split(r.text, chr(10))) END::BIGINT AS n_lines,
               n_dropped::BIGINT AS n_dropped, coalesce(k.text, '') AS text
        FROM rows r JOIN kept k USING (doc_id)""",
    "op11_phrases": f"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_ASCII_LOWER} AS t FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
        ws AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
        grams AS (
          SELECT lang, k, phrase, count(*) AS f FROM (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM ws, (VALUES (1), (2), (3)) v(k)) GROUP BY ALL HAVING count(*) >= 10),
        cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2),
        cuts AS (SELECT *, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)),
        scored AS (
          SELECT c.lang, c.phrase, c.a, c.j, l.f AS l, r.f AS r, (1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f))::BIGINT AS score
          FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = c.head JOIN grams r ON r.lang = c.lang AND r.phrase = c.rest),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        longer AS (
          SELECT lang, phrase, max(a) AS most FROM (
            SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE k = 3) GROUP BY ALL),
        kept AS (SELECT s.* FROM lowest s LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
    "op13_target_encoding": _encoding_sql(),
}
