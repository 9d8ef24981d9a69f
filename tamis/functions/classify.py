"""Query, context and domain classification; clarification rules; prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Verbs, patterns, themes and limits of the classification.
CLEAR_VERBS = ["créer", "modifier", "supprimer", "ajouter", "afficher", "commencer", "démarrer", "ouvrir", "fermer", "enregistrer"]
AMBIGUOUS = [r"^(?:ca|cela|ce|cette)\s*\?$", r"^\s*\?\s*$", r"^[a-zA-Z]{1,2}\s*\?$", r"^qu(?:e|oi)\s+(?:est-ce|faire)\s*\?$"]
QUERY_TYPES = [
    (r"\b(?:comment|how|faire)\b", "procedural"),
    (r"\b(?:pourquoi|why|raison)\b", "explanatory"),
    (r"\b(?:différence|versus|vs|compare)\b", "comparative"),
    (r"\b(?:est-ce que|est-il|possible)\b", "confirmation"),
]
SPECIFIC_WORDS = ["comment", "créer", "modifier", "supprimer"]
STOP_WORDS = ["le", "la", "les", "un", "une", "des", "est", "sont", "a", "ont"]
THEMES = [("configuration", "Configuration"), ("installation", "Installation"), ("erreur", "Résolution d'erreurs"), ("mise à jour", "Mise à jour"), ("sécurité", "Sécurité"), ("performance", "Performance")]
PROCESSES = [
    ("creation", r"(?:créer|nouveau|faire|réaliser|établir)|(?:nouvelle?|nouveau)\s+(?:devis|commande|projet)"),
    ("modification", r"(?:modifier|changer|réviser|mettre à jour)|(?:modification|changement|révision)\s+(?:de|du|des)"),
    ("consultation", r"(?:voir|consulter|afficher|montrer)|(?:où|comment)\s+(?:trouver|voir)"),
]
MAX_THEMES, CONFIDENCE, MIN_DOCS, MIN_WORDS, MIN_DOC_SCORE = 3, 0.5, 1, 2, 0.5
MAX_CLARIFICATIONS, COOLDOWN_SECONDS = 3, 300
MODEL_FAMILIES = ["mistral", "mixtral", "llama", "mt5", "t5", "falcon"]
EMPTY_ANSWER = "Désolé, je n'ai pas pu générer une réponse valide."


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_ambiguous(query: Column) -> Column:
    q = F.lower(query)
    clear = F.lit(False)
    held = F.lit(False)
    for v in CLEAR_VERBS:
        clear = clear | q.startswith(v)
        held = held | q.contains(v)
    vague = F.lit(False)
    for p in AMBIGUOUS:
        vague = vague | q.rlike(p)
    return F.when(clear, False).when(q.startswith("comment") & held, False).otherwise(vague)


def query_type(query: Column) -> Column:
    q, out = F.lower(query), F.lit("informational")
    for p, name in reversed(QUERY_TYPES):
        out = F.when(q.rlike(f"(?U){p}"), name).otherwise(out)
    return out


def complexity(query: Column) -> Column:
    w = words(query)
    total = F.least(F.size(w) / 10, F.lit(1.0)) + 0.1 * F.regexp_count(query, F.lit(r"\b[A-Z][A-Za-z]*(?:\.[A-Za-z]+)+\b"))
    total = total + 0.2 * F.size(F.filter(w, lambda x: F.lower(x).isin(SPECIFIC_WORDS)))
    return F.least(total, F.when(F.lower(query).contains("créer"), 0.5).otherwise(1.0))


def key_concepts(query: Column) -> Column:
    return F.filter(words(F.lower(query)), lambda w: ~w.isin(STOP_WORDS) & (F.length(w) > 3))


def themes(content: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(content).contains(k), name) for k, name in THEMES)))


def response_type(ambiguous: Column, n_themes: Column, kind: Column, complexity_: Column, confidence: Column) -> Column:
    return (
        F.when(ambiguous | (n_themes > MAX_THEMES), "clarification").when((kind == "procedural") | (complexity_ > 0.7), "technical")
        .when((kind == "confirmation") & (confidence > 0.8), "concise").when((complexity_ < 0.3) & (confidence > 0.9), "concise").otherwise("comprehensive")
    )


def clarification_reason(n_themes: Column, confidence: Column, n_docs: Column, ambiguous: Column) -> Column:
    return (
        F.when(n_themes > MAX_THEMES, "multiple_themes").when(confidence < CONFIDENCE, "low_confidence")
        .when(n_docs < MIN_DOCS, "insufficient_context").when(ambiguous, "query_ambiguity").otherwise("general")
    )


def needs_clarification(n_themes: Column, ambiguity: Column, confidence: Column, n_docs: Column, ambiguous: Column, query: Column) -> Column:
    return (n_themes > MAX_THEMES) | (ambiguity > 0.5) | (confidence < CONFIDENCE) | (n_docs < MIN_DOCS) | ambiguous | (F.size(words(query)) < MIN_WORDS)


def process(text: Column) -> Column:
    t, out = F.lower(text), F.lit("inconnu")
    for name, p in reversed(PROCESSES):
        out = F.when(t.rlike(p), name).otherwise(out)
    return out


def process_confidence(kind: Column) -> Column:
    return F.when(kind != "inconnu", 0.5).otherwise(0.0)


def process_response_type(kind: Column) -> Column:
    return F.when(kind.isin("creation", "modification"), "technical").when(kind == "consultation", "comprehensive").otherwise("general")


def process_points(kind: Column) -> Column:
    return F.array_compact(F.array(F.when(kind == "inconnu", "Pourriez-vous préciser le type d'action souhaitée ?"), F.lit("Des détails techniques seraient utiles.")))


def may_ask_again(attempts: Column, last: Column, now: Column) -> Column:
    """Fewer attempts than allowed, and none within the cooldown (whole elapsed time, days included)."""
    elapsed = (F.unix_micros(now) - F.unix_micros(last)) / 1e6
    return (F.coalesce(attempts, F.lit(0)) < MAX_CLARIFICATIONS) & F.coalesce(elapsed >= COOLDOWN_SECONDS, F.lit(True))


def clarification_reply(original: Column, reply: Column) -> dict[str, Column]:
    own = words(F.lower(original))
    return {"is_valid": F.length(F.coalesce(reply, F.lit(""))) > 0, "adds_context": F.size(words(reply)) > F.size(words(original)), "references_original": F.exists(own, lambda w: F.contains(F.lower(reply), w))}


def chat_step(pending: Column, reply_valid: Column, needs: Column, may_ask: Column) -> Column:
    return F.when(pending & reply_valid, "resume").when(needs & may_ask, "clarify").otherwise("answer")


def model_family(name: Column) -> Column:
    n, out = F.lower(name), F.lit("mistral")
    for f in reversed(MODEL_FAMILIES):
        out = F.when(n.contains(f), f).otherwise(out)
    return out


def clean_message(content: Column) -> Column:
    out = F.coalesce(content, F.lit(""))
    for p in (r"\[/?(?:INST|SYSTEM_PROMPT|CONTEXT|RESPONSE_TYPE|CONVERSATION_HISTORY)\]", r"</?s>", r"\s+"):
        out = F.regexp_replace(out, p, " ")
    return F.trim(out)


def clean_response(text: Column) -> Column:
    """After the last instruction mark, without marks and their blocks, single spaces; a set answer if nothing is left."""
    out = F.element_at(F.split(text, r"\[/INST\]"), -1)
    out = F.regexp_replace(out, r"<s>|</s>", "")
    for b in ("SYSTEM_PROMPT", "RESPONSE_TYPE", "CONTEXT"):
        out = F.regexp_replace(out, rf"(?s)\[{b}\].*?\[/{b}\]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(EMPTY_ANSWER))


# Message formats by model family and role.
TEMPLATES = {
    "mistral": {"user": "[INST] %s [/INST]", "context": "[CONTEXT]%s[/CONTEXT]"},
    "mixtral": {"system": "<s><|system|>%s</s>", "user": "<s><|user|>%s</s>", "assistant": "<s><|assistant|>%s</s>", "context": "<s><|context|>%s</s>"},
    "llama": {"system": "<<SYS>>%s<</SYS>>", "user": "[INST]%s[/INST]", "context": "[CTX]%s[/CTX]"},
    "t5": {"system": "system: %s", "user": "question: %s", "assistant": "answer: %s", "context": "context: %s"},
    "falcon": {"system": "System: %s\n", "user": "User: %s\n", "assistant": "Assistant: %s\n", "context": "Context: %s\n"},
}
TEMPLATES["mt5"] = TEMPLATES["t5"]


def format_message(family: Column, role: Column, content: Column) -> Column:
    out = content
    for f, roles in TEMPLATES.items():
        for r, t in roles.items():
            before, after = t.split("%s")
            out = F.when((family == f) & (role == r), F.concat(F.lit(before), content, F.lit(after))).otherwise(out)
    return out


def pair_text(user: Column, assistant: Column) -> Column:
    bare = lambda c: F.regexp_replace(F.trim(c), r"<s>|</s>", "")
    answer = F.regexp_replace(bare(assistant), r"\[RESPONSE_TYPE\].*?\[/RESPONSE_TYPE\]", "")
    return F.concat(F.lit("[INST] "), bare(user), F.lit(" [/INST]"), answer)


def overlay_settings(base: dict, by_type: dict, kind: str) -> dict:
    """Generation settings with those of a response type on top; its style is no setting."""
    return base | {k: v for k, v in by_type.get(kind, {}).items() if k != "style"}


def interpretations(answer: Column) -> Column:
    return F.slice(F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, 3)


# Texts that ask for clarification, by reason.
CLARIFICATIONS = {
    "multiple_themes": ("Votre question touche plusieurs thèmes:\n", "\n\nSur quel aspect spécifique souhaitez-vous des informations ?"),
    "low_confidence": ("Je ne suis pas certain de bien comprendre votre demande.\nVoici ce que j'ai compris : ", "\nPourriez-vous confirmer ou reformuler ?"),
    "insufficient_context": ("Je n'ai pas trouvé suffisamment d'informations précises sur ce sujet.\nPourriez-vous :\n1. Être plus spécifique sur ", "\n2. Donner un exemple concret\n3. Préciser le contexte d'utilisation"),
    "query_ambiguity": ("Votre question pourrait avoir plusieurs interprétations. Voulez-vous dire :\n", ""),
}
PROCESS_SUGGESTIONS = {
    "creation": ["- Pouvez-vous préciser le type d'ouvrage (charpente, serrurerie, etc.) ?", "- Avez-vous des spécifications techniques particulières ?", "- Y a-t-il des contraintes de délai ?"],
    "consultation": ["- Quel type d'information recherchez-vous spécifiquement ?", "- Dans quel contexte avez-vous besoin de ces informations ?"],
}


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def clarification_text(reason: Column, theme_list: Column, understanding: Column, concepts: Column, readings: Column) -> Column:
    """The text of a clarification; unknown reasons ask for the interpretation."""
    fill = {"multiple_themes": bullets(theme_list), "low_confidence": understanding, "insufficient_context": F.array_join(concepts, ", "), "query_ambiguity": bullets(readings)}
    text = lambda k: F.concat(F.lit(CLARIFICATIONS[k][0]), fill[k], F.lit(CLARIFICATIONS[k][1]))
    out = text("query_ambiguity")
    for k in ("multiple_themes", "low_confidence", "insufficient_context"):
        out = F.when(reason == k, text(k)).otherwise(out)
    return out


def process_suggestions(kind: Column) -> Column:
    out = F.lit("")
    for k, lines in PROCESS_SUGGESTIONS.items():
        out = F.when(kind == k, F.lit("\nSuggestions pour clarifier votre demande :\n" + "\n".join(lines))).otherwise(out)
    return out


def system_message(app: str, kind: Column, family: Column, today: Column, language: str = "Français", styles: dict[str, tuple[str, str]] | None = None, prefix: Column | None = None) -> Column:
    """System part of a prompt: principles, date, language, the response type's description and style, a prefix."""
    parts = [F.lit("\n".join([f"Je suis {app}, un assistant spécialisé.", "\nPrincipes fondamentaux :", "- Je fournis des informations précises", "- Je demande des clarifications si nécessaire", "- Je reconnais mes limites", "- Je me concentre sur des solutions pratiques"])),
             F.concat(F.lit("\nDate actuelle : "), F.date_format(today, "dd/MM/yyyy")), F.lit(f"\nLangue : {language}")]
    style = F.lit(None).cast("string")
    for k, (about, how) in (styles or {}).items():
        short = family.isin("t5", "mt5")
        style = F.when((kind == k) & short, f"\nstyle: {about}\ninstructions: {how}").when(kind == k, f"\n[RESPONSE_TYPE]\n{about}\n{how}\n[/RESPONSE_TYPE]").otherwise(style)
    parts.append(style)
    if prefix is not None:
        parts.append(F.concat(F.lit("\nInstructions spécifiques : "), prefix))
    return F.concat_ws("\n", *parts)


def chat_prompt(system: Column, context: Column, pairs: Column, query: Column, family: Column) -> Column:
    """System, context, history pairs and the question, each formatted for the model's family; empty parts are left out."""
    block = lambda role, c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, format_message(family, F.lit(role), c))
    history = F.when(F.size(pairs) > 0, F.array_join(pairs, "\n"))
    return F.concat_ws("\n", block("system", system), block("context", context), history, block("user", query))


def answer(text: Column, documents: Column, confidence: Column, tokens: Column) -> Column:
    """Answer with its documents and figures; a set text where there is none."""
    return F.struct(F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(EMPTY_ANSWER)).alias("response"), F.coalesce(confidence, F.lit(0.0)).alias("confidence_score"), F.coalesce(tokens, F.lit(0)).alias("tokens_used"), documents.alias("documents"))
