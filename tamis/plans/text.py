"""Text, classification and prompt queries. Texts with the marked words are built from documents by their id."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.catalog import register
from tamis.functions import classify as C
from tamis.functions import text as T
from tamis.operators.retrieval import top_k
from tamis.sources.tables import table

#: A text with headers, markers and actions around a document's text; the same expression runs in both engines.
_MADE = """concat(CASE doc_id % 4 WHEN 0 THEN 'CMA' || doc_id || '_REV' || (doc_id % 30) || chr(10) WHEN 1 THEN '=== Page 3 ===' || chr(10) ELSE '' END,
 'Pour commencer ' || lang || chr(10), CASE WHEN doc_id % 3 = 0 THEN '1) Ouvrir la page' || chr(10) || 'puis cliquez ici' || chr(10) ELSE '' END, replace(text, chr(10), ' '), chr(10),
 CASE WHEN doc_id % 5 = 0 THEN '2. Fermer' || chr(10) || chr(10) || chr(10) ELSE '' END, '  - fin   du texte  ', chr(10), CASE WHEN doc_id % 7 = 0 THEN 'Historique des révisions v' || doc_id ELSE 'Page 1 sur 9' END)"""
_MADE_SPARK = _MADE
_ASK = """CASE doc_id % 9 WHEN 0 THEN 'Comment créer une commande ?' WHEN 1 THEN 'cela ?' WHEN 2 THEN 'Pourquoi cette erreur dans ' || source || ' ?' WHEN 3 THEN 'différence entre ' || lang || ' et Module.Sous.Vue'
 WHEN 4 THEN 'est-ce que la configuration est possible' WHEN 5 THEN '?' WHEN 6 THEN 'Modifier la mise à jour de sécurité et performance de installation' WHEN 7 THEN 'ab ?' ELSE 'voir ' || text END"""


def made(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_MADE_SPARK).alias("content"))


def asks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_ASK).alias("query"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"))


#: DuckDB's \s is ASCII like Java's; its multi-line anchors need (?m).
_CLEAN = _MADE
for _p in (r"(?s)=== Page [0-9]+ ===", r"(?m)^Page [0-9]+ sur [0-9]+$", r"(?is)Historique des révisions.*"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_CLEAN = f"regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[ \\t\\n\\r]{{2,}}', ' ', 'g'), '(?m)^[ \\t\\n\\r]+', '', 'g'), '(?m)[ \\t\\n\\r]+$', '', 'g')"
_CLEAN = f"array_to_string(list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: trim(x, ' ' || chr(9))), lambda x: x <> ''), chr(10))"


@register("clean_text", f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents")
def clean_text(spark, d):
    return made(spark, d).select("doc_id", T.clean(F.col("content")).alias("cleaned"))


@register("revision", f"SELECT doc_id, coalesce(nullif(regexp_extract(lower({_MADE}), 'rev([0-9]+)', 1), ''), '00') AS revision FROM documents")
def revision(spark, d):
    return made(spark, d).select("doc_id", T.revision(F.col("content")).alias("revision"))


_LINES = f"""SELECT doc_id, i, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
SELECT doc_id, list_filter(list_transform(string_split({_MADE}, chr(10)), lambda x: regexp_replace(x, '^[ \\t]+|[ \\t]+$', '', 'g')), lambda x: x <> '') AS l FROM documents))"""
_MARK = "(regexp_matches(line, '(?i)^(Pour|Comment)[ \\t]+[a-zéèêë].*?$') OR regexp_matches(line, '^([0-9]+[).]|[-•])[ \\t]+.*$') OR regexp_matches(line, '(?i)^(Étape|Phase|Partie)[ \\t]+.*:?$') OR regexp_matches(lower(line), '(^|[^a-zà-ÿ0-9_])(cliquez|sélectionnez|renseignez|faites)($|[^a-zà-ÿ0-9_])'))"
_SECTIONS = f"""WITH l AS ({_LINES}), g AS (SELECT *, sum(CASE WHEN i > 1 AND {_MARK} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section_idx FROM l),
s AS (SELECT doc_id, CAST(section_idx AS BIGINT) AS section_idx, string_agg(line, chr(10) ORDER BY i) AS content FROM g GROUP BY 1, 2),
n AS (SELECT *, len(regexp_extract_all(lower(content), '(^|[^a-zà-ÿ0-9_])(cliquez|sélectionnez|renseignez|faites)($|[^a-zà-ÿ0-9_])')) AS actions, len(regexp_extract_all(content, '(?m)^[0-9]+[.)]')) AS steps FROM s),
r AS (SELECT *, least(1.0, actions * 0.2 + steps * 0.15 + greatest(0.0, 1 - section_idx * 0.1) + CASE WHEN length(content) > 100 AND length(content) < 1000 THEN 0.1 ELSE 0.0 END) AS score FROM n)"""


@register("section_split", _SECTIONS + " SELECT doc_id, section_idx, content FROM s")
def section_split(spark, d):
    return T.sections(made(spark, d)).select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), "content")


@register("section_scores", _SECTIONS + " SELECT doc_id, section_idx, trim(substr(string_split(content, chr(10))[1], 1, 100)) AS title, round(score, 6) AS importance_score, CAST(len(regexp_extract_all(content, '[^ \\t\\n]+')) AS BIGINT) AS word_count, steps > 0 AS has_steps, actions > 0 AS has_actions FROM r", doubles=("importance_score",))
def section_scores(spark, d):
    rows = T.scored_sections(made(spark, d))
    return rows.select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), F.col("title"), F.round("importance_score", 6).alias("importance_score"), F.col("word_count").cast("long").alias("word_count"), "has_steps", "has_actions")


_QREL = "len(list_intersect(['pour', 'page', 'de'], list_distinct(regexp_extract_all(lower(content), '[^ \\t\\n]+')))) / 3.0"


@register("section_topk", _SECTIONS + f" SELECT doc_id, section_idx, round(score * (1 + {_QREL}), 6) AS boosted FROM r ORDER BY round(score * (1 + {_QREL}), 6) DESC, doc_id, section_idx LIMIT 25")
def section_topk(spark, d):
    rows = T.scored_sections(made(spark, d))
    boosted = F.round(F.col("importance_score") * (1 + T.query_relevance(F.col("content"), F.lit("Pour page de"))), 6)
    return top_k(rows.select("doc_id", F.col("section_idx").cast("long").alias("section_idx"), boosted.alias("boosted")), 25, [F.desc("boosted"), F.asc("doc_id"), F.asc("section_idx")])


@register("keyword_positions", "SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 4) WHERE lower(substr(text, i, 4)) = 'thth'")
def keyword_positions(spark, d):
    docs = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("thth")))
    return docs.select("doc_id", F.explode(T.keyword_positions(F.col("text"), F.lit("thth"))).alias("pos")).select("doc_id", F.col("pos").cast("long").alias("pos"))


_FRAG = "substr(text, greatest(0, p - 50) + 1, least(length(text), p + 4 + 50) - greatest(0, p - 50))"


@register("fragments_topk", f"""SELECT doc_id, pos, fragment, confidence FROM (SELECT doc_id, p AS pos, fragment, round(least(1.0, (length(lower(fragment)) - length(replace(lower(fragment), 'thth', ''))) / 4.0 * (100.0 / greatest(1, len(regexp_extract_all(fragment, '[^ \\t\\n]+'))))), 6) AS confidence FROM (
SELECT doc_id, text, CAST(p AS BIGINT) AS p, {_FRAG} AS fragment FROM (SELECT doc_id, text, i - 1 AS p FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 3)) AS i FROM documents WHERE length(text) >= 4) WHERE lower(substr(text, i, 4)) = 'thth'))) ORDER BY confidence DESC, doc_id, pos LIMIT 30""")
def fragments_topk(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    rows = T.fragments(pages, ["thth"], 50).select("doc_id", F.col("pos").cast("long").alias("pos"), "fragment", F.round("confidence", 6).alias("confidence"))
    return top_k(rows, 30, [F.desc("confidence"), F.asc("doc_id"), F.asc("pos")])


@register("chunk_documents", """SELECT doc_id, CAST(i AS BIGINT) AS chunk_index, CAST(length(substr(text, i * 1350 + 1, 1500)) AS BIGINT) AS chunk_size, md5(substr(text, i * 1350 + 1, 1500)) AS digest FROM (
SELECT doc_id, text, unnest(generate_series(0, CAST(greatest(0, ceil((length(text) - 150) / 1350.0) - 1) AS BIGINT))) AS i FROM documents WHERE length(text) > 0)""")
def chunk_documents(spark, d):
    rows = T.chunks(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")))
    return rows.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk_size").cast("long").alias("chunk_size"), F.md5(F.col("content").cast("binary")).alias("digest"))


_VERBS = "['créer', 'modifier', 'supprimer', 'ajouter', 'afficher', 'commencer', 'démarrer', 'ouvrir', 'fermer', 'enregistrer']"
_AMB = f"""CASE WHEN len(list_filter({_VERBS}, lambda v: starts_with(lower(query), v))) > 0 THEN false WHEN starts_with(lower(query), 'comment') AND len(list_filter({_VERBS}, lambda v: contains(lower(query), v))) > 0 THEN false
ELSE regexp_matches(lower(query), '^(ca|cela|ce|cette)[ ]*\\?$') OR regexp_matches(query, '^[ ]*\\?[ ]*$') OR regexp_matches(query, '^[a-zA-Z]{{1,2}}[ ]*\\?$') OR regexp_matches(lower(query), '^qu(e|oi)[ ]+(est-ce|faire)[ ]*\\?$') END"""
_W = lambda w: f"regexp_matches(lower(query), '(^|[^a-zà-ÿ0-9_])({w})($|[^a-zà-ÿ0-9_])')"
_TYPE = f"CASE WHEN {_W('comment|how|faire')} THEN 'procedural' WHEN {_W('pourquoi|why|raison')} THEN 'explanatory' WHEN {_W('différence|versus|vs|compare')} THEN 'comparative' WHEN {_W('est-ce que|est-il|possible')} THEN 'confirmation' ELSE 'informational' END"
_WORDS = "regexp_extract_all(query, '[^ \\t\\n]+')"
_CPX = f"""least(least(len({_WORDS}) / 10.0, 1.0) + 0.1 * len(regexp_extract_all(query, '\\b[A-Z][A-Za-z]*(\\.[A-Za-z]+)+\\b')) + 0.2 * len(list_filter({_WORDS}, lambda w: lower(w) IN ('comment', 'créer', 'modifier', 'supprimer'))), CASE WHEN contains(lower(query), 'créer') THEN 0.5 ELSE 1.0 END)"""
_THEME_LIST = " || ".join(f"CASE WHEN contains(lower(query), '{k}') THEN ['{n.replace(chr(39), chr(39) * 2)}'] ELSE [] END" for k, n in C.THEMES)
_Q = f"(SELECT doc_id, {_ASK} AS query, (doc_id % 10) / 10.0 AS confidence FROM documents)"


@register("query_ambiguity", f"SELECT doc_id, {_AMB} AS ambiguous FROM {_Q}")
def query_ambiguity(spark, d):
    return asks(spark, d).select("doc_id", C.is_ambiguous(F.col("query")).alias("ambiguous"))


@register("query_type", f"SELECT doc_id, {_TYPE} AS query_type FROM {_Q}")
def query_type(spark, d):
    return asks(spark, d).select("doc_id", C.query_type(F.col("query")).alias("query_type"))


@register("query_complexity", f"SELECT doc_id, round({_CPX}, 6) AS complexity FROM {_Q}")
def query_complexity(spark, d):
    return asks(spark, d).select("doc_id", F.round(C.complexity(F.col("query")), 6).alias("complexity"))


@register("key_concepts", f"SELECT doc_id, array_to_string(list_filter(list_transform({_WORDS}, lambda w: lower(w)), lambda w: NOT w IN ('le', 'la', 'les', 'un', 'une', 'des', 'est', 'sont', 'a', 'ont') AND length(w) > 3), ' ') AS concepts FROM {_Q}")
def key_concepts(spark, d):
    return asks(spark, d).select("doc_id", F.array_join(C.key_concepts(F.col("query")), " ").alias("concepts"))


@register("themes", f"SELECT doc_id, array_to_string({_THEME_LIST}, '|') AS themes, CAST(len({_THEME_LIST}) AS BIGINT) AS n_themes FROM {_Q}")
def themes(spark, d):
    t = C.themes(F.col("query"))
    return asks(spark, d).select("doc_id", F.array_join(t, "|").alias("themes"), F.size(t).cast("long").alias("n_themes"))


_FULL = f"(SELECT *, {_AMB} AS amb, {_TYPE} AS kind, {_CPX} AS cpx, len({_THEME_LIST}) AS nt, doc_id % 4 AS n_docs FROM {_Q})"


@register("response_type", f"SELECT doc_id, CASE WHEN amb OR nt > 3 THEN 'clarification' WHEN kind = 'procedural' OR cpx > 0.7 THEN 'technical' WHEN kind = 'confirmation' AND confidence > 0.8 THEN 'concise' WHEN cpx < 0.3 AND confidence > 0.9 THEN 'concise' ELSE 'comprehensive' END AS response_type FROM {_FULL}")
def response_type(spark, d):
    q = F.col("query")
    return asks(spark, d).select("doc_id", C.response_type(C.is_ambiguous(q), F.size(C.themes(q)), C.query_type(q), C.complexity(q), F.col("confidence")).alias("response_type"))


@register("clarification_reason", f"SELECT doc_id, CASE WHEN nt > 3 THEN 'multiple_themes' WHEN confidence < 0.5 THEN 'low_confidence' WHEN n_docs < 1 THEN 'insufficient_context' WHEN amb THEN 'query_ambiguity' ELSE 'general' END AS reason, nt > 3 OR confidence < 0.5 OR n_docs < 1 OR amb OR len({_WORDS}) < 2 AS needed FROM {_FULL}")
def clarification_reason(spark, d):
    q, n = F.col("query"), F.size(C.themes(F.col("query")))
    docs = F.col("doc_id") % 4
    return asks(spark, d).select("doc_id", C.clarification_reason(n, F.col("confidence"), docs, C.is_ambiguous(q)).alias("reason"), C.needs_clarification(n, F.lit(0.0), F.col("confidence"), docs, C.is_ambiguous(q), q).alias("needed"))


@register("theme_ambiguity", f"""WITH t AS (SELECT doc_id % 50 AS query_id, ({_THEME_LIST}) AS th FROM {_Q} WHERE confidence >= 0.5), a AS (SELECT query_id, round(0.2 * count(*) FILTER (WHERE len(th) > 1), 6) AS ambiguity FROM t GROUP BY 1),
s AS (SELECT query_id, array_to_string(list_sort(list(DISTINCT x)), '|') AS themes FROM (SELECT query_id, unnest(th) AS x FROM t) GROUP BY 1) SELECT a.query_id, ambiguity, coalesce(themes, '') AS themes FROM a LEFT JOIN s USING (query_id)""", doubles=("ambiguity",))
def theme_ambiguity(spark, d):
    rows = asks(spark, d).filter(F.col("confidence") >= C.MIN_DOC_SCORE).select((F.col("doc_id") % 50).alias("query_id"), C.themes(F.col("query")).alias("t"))
    out = rows.groupBy("query_id").agg(F.round(0.2 * F.count_if(F.size("t") > 1), 6).alias("ambiguity"), F.array_distinct(F.flatten(F.collect_set("t"))).alias("t"))  # sets of a fixed theme list
    return out.select("query_id", "ambiguity", F.array_join(F.array_sort("t"), "|").alias("themes"))


_PROC = f"CASE WHEN regexp_matches(lower(query), '(créer|nouveau|faire|réaliser|établir)|(nouvelle?|nouveau)[ ]+(devis|commande|projet)') THEN 'creation' WHEN regexp_matches(lower(query), '(modifier|changer|réviser|mettre à jour)|(modification|changement|révision)[ ]+(de|du|des)') THEN 'modification' WHEN regexp_matches(lower(query), '(voir|consulter|afficher|montrer)|(où|comment)[ ]+(trouver|voir)') THEN 'consultation' ELSE 'inconnu' END"


@register("domain_process", f"SELECT doc_id, p AS process, CASE WHEN p <> 'inconnu' THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN p IN ('creation', 'modification') THEN 'technical' WHEN p = 'consultation' THEN 'comprehensive' ELSE 'general' END AS response_type, CAST(CASE WHEN p = 'inconnu' THEN 2 ELSE 1 END AS BIGINT) AS n_points FROM (SELECT doc_id, {_PROC} AS p FROM {_Q})", doubles=("confidence",))
def domain_process(spark, d):
    rows = asks(spark, d).select("doc_id", C.process(F.col("query")).alias("process"))
    p = F.col("process")
    return rows.select("doc_id", p, C.process_confidence(p).alias("confidence"), C.process_response_type(p).alias("response_type"), F.size(C.process_points(p)).cast("long").alias("n_points"))


@register("clarification_cooldown", """SELECT event_id, event_id % 5 < 3 AND coalesce((epoch_us(TIMESTAMP '2024-01-16 00:00:00') - epoch_us(CASE WHEN event_id % 3 <> 0 THEN ts END)) / 1e6 >= 300, true) AS may_ask FROM events""")
def clarification_cooldown(spark, d):
    last = F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", C.may_ask_again(F.col("event_id") % 5, last, F.expr("TIMESTAMP '2024-01-16 00:00:00'")).alias("may_ask"))


@register("clarification_reply", """SELECT conv_id, turn, length(reply) > 0 AS is_valid, len(regexp_extract_all(reply, '[^ \\t\\n\\r]+')) > len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS adds_context, len(list_filter(regexp_extract_all(lower(text), '[^ \\t\\n\\r]+'), lambda w: contains(lower(reply), w))) > 0 AS references_original
FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM conversations) WHERE reply IS NOT NULL""")
def clarification_reply(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("reply", F.lead("text").over(w)).filter("reply is not null")
    return rows.select("conv_id", "turn", *(v.alias(k) for k, v in C.clarification_reply(F.col("text"), F.col("reply")).items()))


@register("chat_flow", "SELECT event_id, CASE WHEN event_type = 'click' AND value > 50 THEN 'resume' WHEN value < 30 AND event_id % 4 < 3 THEN 'clarify' ELSE 'answer' END AS step FROM events")
def chat_flow(spark, d):
    return table(spark, d, "events").select("event_id", C.chat_step(F.col("event_type") == "click", F.col("value") > 50, F.col("value") < 30, F.col("event_id") % 4 < 3).alias("step"))


_NAME = "CASE doc_id % 7 WHEN 0 THEN 'Mistral-7B' WHEN 1 THEN 'mixtral-8x7b' WHEN 2 THEN 'Llama-2' WHEN 3 THEN 'google/mt5-base' WHEN 4 THEN 't5-small' WHEN 5 THEN 'Falcon-40b' ELSE 'other' END"
_FAM = "CASE doc_id % 7 WHEN 1 THEN 'mixtral' WHEN 2 THEN 'llama' WHEN 3 THEN 'mt5' WHEN 4 THEN 't5' WHEN 5 THEN 'falcon' ELSE 'mistral' END"


@register("prompt_templates", f"""SELECT doc_id, {_FAM} AS family, CASE {_FAM} WHEN 'mistral' THEN '[INST] ' || c || ' [/INST]' WHEN 'mixtral' THEN '<s><|user|>' || c || '</s>' WHEN 'llama' THEN '[INST]' || c || '[/INST]' WHEN 'falcon' THEN 'User: ' || c || chr(10) ELSE 'question: ' || c END AS prompt FROM (SELECT doc_id, text AS c FROM documents)""")
def prompt_templates(spark, d):
    rows = table(spark, d, "documents").select("doc_id", C.model_family(F.expr(_NAME)).alias("family"), F.col("text").alias("c"))
    return rows.select("doc_id", "family", C.format_message(F.col("family"), F.lit("user"), F.col("c")).alias("prompt"))


_MSG = "'<s>[INST] ' || lang || ' [/INST]' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '[RESPONSE_TYPE]x' || chr(10) || 'y[/RESPONSE_TYPE]  ' || text || '   [CONTEXT]z[/CONTEXT]</s>' END"
_SP = "[ \\t\\n\\r]+"


@register("message_cleanup", f"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace({_MSG}, '\\[/?(INST|SYSTEM_PROMPT|CONTEXT|RESPONSE_TYPE|CONVERSATION_HISTORY)\\]', ' ', 'g'), '</?s>', ' ', 'g'), '{_SP}', ' ', 'g')) AS cleaned FROM documents")
def message_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_message(F.expr(_MSG)).alias("cleaned"))


@register("response_cleanup", f"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(list_extract(string_split({_MSG}, '[/INST]'), -1), '<s>|</s>', '', 'g'), '(?s)\\[RESPONSE_TYPE\\].*?\\[/RESPONSE_TYPE\\]', '', 'g'), '(?s)\\[CONTEXT\\].*?\\[/CONTEXT\\]', '', 'g'), '{_SP}', ' ', 'g')), ''), 'Désolé, je n''ai pas pu générer une réponse valide.') AS answer FROM documents""")
def response_cleanup(spark, d):
    return table(spark, d, "documents").select("doc_id", C.clean_response(F.expr(_MSG)).alias("answer"))


@register("conversation_prompts", """SELECT conv_id, turn, '[INST] ' || trim(q) || ' [/INST]' || trim(a) AS pair FROM (SELECT conv_id, turn, role, text AS q, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND nr = 'assistant'""")
def conversation_prompts(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumns({"nr": F.lead("role").over(w), "a": F.lead("text").over(w)}).filter("role = 'user' and nr = 'assistant'")
    return rows.select("conv_id", "turn", C.pair_text(F.col("text"), F.col("a")).alias("pair"))


@register("summary_inputs", """SELECT source AS app, substr(string_agg('[Source: ' || lang || ']' || chr(10) || trim(text), chr(10) || '---' || chr(10) ORDER BY doc_id), 1, 1024) AS summary_input FROM documents WHERE trim(text) <> '' GROUP BY 1""")
def summary_inputs(spark, d):
    rows = table(spark, d, "documents").select(F.col("source").alias("app"), "doc_id", F.col("lang").alias("application"), F.col("text").alias("content"))
    return T.summary_input(rows, "app")


@register("interpretations", """SELECT doc_id, array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1, 3), '|') AS interpretations FROM documents""")
def interpretations(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.interpretations(F.col("text")), "|").alias("interpretations"))


@register("cache_keys", "SELECT doc_id, md5(source || ':' || lang || ':' || CAST(n_chars AS VARCHAR)) AS cache_key FROM documents")
def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.md5_key(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("cache_key"))


@register("token_counts_proxy", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+')) AS BIGINT) AS n_tokens FROM documents")
def token_counts_proxy(spark, d):
    return table(spark, d, "documents").select("doc_id", T.token_proxy(F.col("text")).cast("long").alias("n_tokens"))


@register("page_links_text")
def page_links_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"), F.size(T.links_of(F.col("html"))).alias("n_links"))
