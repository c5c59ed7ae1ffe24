"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotloom.llm import bytebpe, conversations, decontam, lmscore, merkle, mixture, neardup, records, repeats, templates, toxicity, vectors

TOKENIZER = "word_bpe_49k.json"
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents to binary records, read them back and describe each."""
    return records.encode_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better a model of the documents of good quality predicts each document than a model of all."""
    target = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(_table(spark, sf_dir, "documents"), target)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels that are not held out."""
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), 0.3)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that each document holds."""
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 80, 5)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes from each document."""
    return mixture.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every byte covered by a 200-byte string that starts anywhere else."""
    return repeats.remove_repeated_bytes(_table(spark, sf_dir, "documents"), 200)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove every word covered by 13 words that also start in an earlier document."""
    return repeats.remove_repeated_words(_table(spark, sf_dir, "documents"), 13)


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are 85 % alike."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 85, 3)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with cosine of 0.95 or more."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), 0.95)


def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines dropped from each document because their template recurs."""
    out = templates.drop_recurring_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered leaf folds to."""
    return merkle.documents_manifest(_table(spark, sf_dir, "documents"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by byte-level BPE, and the text that they decode to."""
    return bytebpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest edits that mend every damaged conversation."""
    return conversations.damage_and_repair(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_records": op1_token_records,
    "op2_lm_scores": op2_lm_scores,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_source_mix": op5_source_mix,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash_dedup": op8_minhash_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_line_templates": op10_line_templates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_repair": op13_conversation_repair,
}
_WORD = r"[^\x20\x09-\x0D]+"
_MASKED = r"regexp_replace(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g')"
_REACH = """links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)"""


def _crc32(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of an ASCII text."""
    bit = "list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: {bit}), 4294967295)"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR END"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"


def _repair_sql() -> str:
    """DuckDB SQL of op13: costs, audits and repaired texts to go, from a conversation's last row to its first."""
    state = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"
    far = f"struct_pack(c := 1000000000000, a := '', t := '')::{state}"
    insert = lambda g, role: f"struct_pack(c := {g}.c + 5, a := 'I' || {g}.a, t := chr(10) || '{role}:' || {g}.t)"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"

    def row(q: str, due: str, role: str, keeps: list[tuple[str, str]]) -> str:
        delete = f"struct_pack(c := {q}.c + 2, a := 'D' || {q}.a, t := {q}.t)"
        rerole = f"CASE WHEN gone THEN {far} ELSE struct_pack(c := {due}.c + 1 + more, a := 'R' || {due}.a, t := chr(10) || '{role}:' || text || {due}.t) END"
        kept = " ".join(f"WHEN NOT gone AND i = '{i}' THEN struct_pack(c := {to}.c + more, a := 'K' || {to}.a, t := chr(10) || role || ':' || text || {to}.t)" for i, to in keeps)
        return least(delete, rerole, f"CASE {kept} ELSE {far} END")

    h0, h1 = row("g0", "g2", "user", [("s", "g1"), ("u", "g2")]), row("g1", "g2", "user", [("u", "g2")])
    h2, h3 = row("g2", "g3", "assistant", [("a", "g3")]), row("g3", "g2", "user", [("u", "g2")])
    crc = _crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    begin = f"struct_pack(c := 0::BIGINT, a := '', t := '')::{state}"
    return rf"""WITH RECURSIVE k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
        o AS (SELECT *, row_number() OVER w AS pos, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again, left(role, 1) AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
        f AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
        x AS MATERIALIZED (SELECT conv_id, pos, role, i, text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM f),
        st(conv_id, pos, g0, g1, g2, g3) AS (SELECT conv_id, max(pos) + 1, {begin}, struct_pack(c := 10::BIGINT, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:')::{state}, struct_pack(c := 5::BIGINT, a := 'I', t := chr(10) || 'assistant:')::{state}, {begin} FROM x GROUP BY 1
            UNION ALL SELECT conv_id, pos, {least("h0", insert("e2", "user"))}, {least("h1", insert("e2", "user"))}, e2, {least("h3", insert("h2", "user"))}
            FROM (SELECT *, {least("h2", insert("h3", "assistant"))} AS e2 FROM (SELECT st.conv_id, x.pos, {h0} AS h0, {h1} AS h1, {h2} AS h2, {h3} AS h3 FROM st JOIN x ON x.conv_id IS NOT DISTINCT FROM st.conv_id AND x.pos = st.pos - 1))),
        told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
            count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(st.g0.c, 0) AS cost, coalesce(st.g0.a, '') AS audit,
            sha256(coalesce(substr(st.g0.t, 2), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN st ON st.conv_id IS NOT DISTINCT FROM c.conv_id AND st.pos = 1"""


def _merkle_sql() -> str:
    """DuckDB SQL of op11: levels of every tree and of the tree over their roots, then each leaf's siblings from the lowest up."""
    up = lambda name, seed: f"{name}(tree, n, lvl, i, d) AS ({seed} UNION ALL SELECT tree, n, lvl + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)) FROM {name} WHERE n > (1::BIGINT << lvl) GROUP BY tree, n, lvl, i // 2)"
    fold = "CASE WHEN sib.d IS NULL THEN sha256({d}) WHEN {i} % 2 = 1 THEN sha256(sib.d || {d}) ELSE sha256({d} || sib.d) END"
    changed = _LEAF.replace("n_chars", "(n_chars + 1)")
    return f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, lang, {_LEAF} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 AND doc_id IS NOT NULL AND n_chars IS NOT NULL THEN {changed} ELSE {_LEAF} END AS mine FROM documents),
        p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, coalesce('=' || lang, '') AS tree FROM l),
        {up("low", "SELECT tree, n, 0::INT, i, leaf FROM p")},
        sub AS MATERIALIZED (SELECT tree, max_by(d, lvl) AS subroot FROM low GROUP BY 1),
        t AS MATERIALIZED (SELECT tree, subroot, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM sub),
        {up("high", "SELECT 'all', n, 0::INT, i, subroot FROM t")},
        root AS (SELECT max_by(d, lvl) AS root FROM high),
        lows AS MATERIALIZED (SELECT * FROM low), highs AS MATERIALIZED (SELECT * FROM high),
        w(doc_id, leaf, tree, n, i, lvl, d, proof) AS (SELECT doc_id, leaf, tree, n, i, 0::INT, mine, '' FROM p
            UNION ALL SELECT w.doc_id, w.leaf, w.tree, w.n, w.i // 2, w.lvl + 1, {fold.format(d="w.d", i="w.i")}, w.proof || coalesce(sib.d, '') FROM w LEFT JOIN lows sib ON sib.tree = w.tree AND sib.lvl = w.lvl AND sib.i = xor(w.i, 1) WHERE w.n > (1::BIGINT << w.lvl)),
        half AS MATERIALIZED (SELECT w.doc_id, w.leaf, w.d, w.proof, t.subroot, t.i, t.n FROM w JOIN t ON t.tree = w.tree WHERE NOT w.n > (1::BIGINT << w.lvl)),
        z(doc_id, leaf, subroot, n, i, lvl, d, proof) AS (SELECT doc_id, leaf, subroot, n, i, 0::INT, d, proof FROM half
            UNION ALL SELECT z.doc_id, z.leaf, z.subroot, z.n, z.i // 2, z.lvl + 1, {fold.format(d="z.d", i="z.i")}, z.proof || coalesce(sib.d, '') FROM z LEFT JOIN highs sib ON sib.lvl = z.lvl AND sib.i = xor(z.i, 1) WHERE z.n > (1::BIGINT << z.lvl))
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, d AS folded_root, d = root AS verified FROM z, root WHERE NOT z.n > (1::BIGINT << z.lvl)"""


ORACLES: dict[str, str] = {
    "op5_source_mix": f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('17:' || doc_id) AS digest FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, source_size * 3.0::DOUBLE AS cap FROM s),
        f AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, CASE WHEN ratio <= level THEN cap ELSE weight * max(CASE WHEN ratio > level THEN level END) OVER () END AS target FROM f),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM t),
        r AS (SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
            FROM d JOIN e ON e.source IS NOT DISTINCT FROM d.source),
        g AS (SELECT source, CASE WHEN bool_and(upto <= rest) THEN 0 ELSE max(rest) - coalesce(max(upto) FILTER (upto <= rest), 0) END AS gap FROM r GROUP BY 1),
        p AS (SELECT r.source, arg_min(digest, (abs(size - gap), digest)) AS filler FROM r JOIN g ON g.source IS NOT DISTINCT FROM r.source WHERE upto > rest AND rest > 0 AND abs(size - gap) < gap GROUP BY 1)
        SELECT doc_id, size, source_size, target, (size * (whole + (rest > 0 AND (upto <= rest OR digest = coalesce(filler, '')))::INT))::BIGINT AS taken, (whole + (rest > 0 AND (upto <= rest OR digest = coalesce(filler, '')))::INT)::INT AS repeats
        FROM r LEFT JOIN p ON p.source IS NOT DISTINCT FROM r.source""",
    "op10_line_templates": f"""WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        each AS (SELECT rid, doc_id, text, pos, raw, {_MASKED} AS line FROM (SELECT rid, doc_id, text, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM rows)),
        known AS (SELECT line, string_split(line, ' ') AS w, count(DISTINCT (doc_id, text)) AS docs FROM each WHERE line <> '' GROUP BY 1),
        spread AS (SELECT line, docs, [len(w)::VARCHAR, w[1], w[2]] AS leaf, unnest(w) AS token, generate_subscripts(w, 1) AS place FROM known WHERE len(w) > 2),
        fixed AS (SELECT leaf, place, token FROM spread GROUP BY 1, 2, 3 HAVING sum(docs) >= 10),
        shaped AS (SELECT s.line, list_prepend(array_to_string(any_value(s.leaf), chr(10)), list(CASE WHEN f.token IS NULL THEN '<*>' ELSE s.token END ORDER BY s.place)) AS template,
            avg((f.token IS NOT NULL AND s.token <> '<*>')::INT::DOUBLE) AS share FROM spread s LEFT JOIN fixed f ON f.leaf = s.leaf AND f.place = s.place AND f.token = s.token GROUP BY 1),
        named AS (SELECT k.line, coalesce(s.template, ['', k.line]) AS template FROM known k LEFT JOIN (SELECT * FROM shaped WHERE share >= 0.6) s ON s.line = k.line),
        gone AS (SELECT line FROM named WHERE template IN (SELECT n.template FROM named n JOIN each e ON e.line = n.line GROUP BY 1 HAVING count(DISTINCT (e.doc_id, e.text)) >= 10))
        SELECT any_value(e.doc_id) AS doc_id, count(*)::INT AS n_lines, count(g.line)::INT AS n_dropped, sha256(coalesce(string_agg(e.raw, chr(10) ORDER BY e.pos) FILTER (g.line IS NULL), '')) AS kept_sha256
        FROM each e LEFT JOIN gone g ON g.line = e.line GROUP BY e.rid""",
    "op6_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (SELECT rid, 500 * j AS first, substr(h, 1000 * j + 1, 1398) AS h FROM (SELECT rid, h, unnest(range(length(h) // 1000 + 1)) AS j FROM d)),
        w AS (SELECT rid, first + i AS i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * i + 400 <= length(h) THEN md5(substr(h, 2 * i + 1, 400)) END AS k FROM (SELECT rid, first, h, unnest(range(least(500, length(h) // 2))) AS i FROM blocks)),
        again AS (SELECT k FROM w WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1),
        m AS (SELECT w.rid, w.i, w.b, max(a.k) OVER (PARTITION BY w.rid ORDER BY w.i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM w LEFT JOIN again a ON a.k = w.k),
        s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY i), false) AS begins FROM m),
        told AS (SELECT rid, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY 1)
        SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN told ON told.rid = d.rid""",
    "op7_substring_dedup": f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
        x AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        first AS (SELECT k, min(doc_id) AS least FROM x GROUP BY 1),
        gone AS (SELECT DISTINCT x.doc_id, x.i + j AS pos FROM x JOIN first ON first.k = x.k AND first.least < x.doc_id, (SELECT unnest(range(13)) AS j)),
        each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d),
        told AS (SELECT e.doc_id, count(*) AS n_words, count(g.pos) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS kept FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.pos = e.pos GROUP BY 1)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN told ON told.doc_id = d.doc_id""",
    "op8_minhash_dedup": f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
        x AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 2) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
        n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.k = b.k AND a.doc_id < b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
        {_REACH}, c AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, coalesce(c.component, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op9_embedding_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
        pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM e x JOIN e y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.95),
        {_REACH}, c AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, vec_id) AS component_id, coalesce(c.component, vec_id) = vec_id AS kept FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id""",
    "op11_merkle_manifest": _merkle_sql(),
    "op13_conversation_repair": _repair_sql(),
}
