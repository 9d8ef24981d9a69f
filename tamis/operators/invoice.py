"""Invoice and form structuring over cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Key words of table roles, column roles, totals, terms and truth.
HEADER = ["facture", "invoice", "client", "date", "numéro", "number", "adresse", "address"]
LINE_ITEM = ["description", "quantité", "quantity", "prix", "price", "montant", "amount", "total"]
TOTALS = ["total", "sous-total", "subtotal", "tva", "vat", "tax", "ttc", "ht"]
CLIENT = ["client", "nom", "name", "adresse", "address", "contact", "tel", "email"]
PRODUCT = ["produit", "product", "référence", "reference", "modèle", "model"]
SERVICE = ["service", "prestation", "intervention", "maintenance", "support"]
OPTION = ["option", "accessoire", "accessory", "supplément", "add-on"]
TERMS = ["condition", "term", "clause", "garantie", "warranty", "livraison", "delivery"]
TOTAL_LABEL = ["total", "sous", "sub", "tva", "vat", "tax", "ht", "ttc"]
REFERENCE = ["référence", "reference", "ref", "devis", "numéro", "number"]
TERM_CATEGORIES = [
    ("warranty", ["garantie", "warranty", "guarantee"]), ("delivery", ["livraison", "delivery", "shipping"]), ("payment", ["paiement", "payment", "règlement", "settlement"]),
    ("cancellation", ["annulation", "cancellation", "résiliation", "termination"]), ("confidentiality", ["confidentialité", "confidentiality", "privacy"]),
]
TRUE_WORDS = ["oui", "yes", "true", "vrai", "1", "x", "✓", "checked", "coché"]
COLUMN_ROLES = [
    ("description", ["description", "produit", "service"]), ("quantity", ["quantité", "quantity", "qty"]), ("price", ["prix", "price", "unit"]),
    ("total", ["total", "montant", "amount"]), ("tax", ["tva", "vat", "tax"]),
]
HEADER_FIELDS = [("invoice_number", ["facture", "invoice"]), ("invoice_date", ["date"]), ("client_name", ["client", "customer"]), ("client_address", ["adresse", "address"]), ("due_date", ["échéance", "due"])]
CLIENT_FIELDS = [("name", ["nom", "name"]), ("address", ["adresse", "address"]), ("email", ["email", "courriel"]), ("phone", ["téléphone", "telephone", "phone"]), ("contact", ["contact"])]


def holds_any(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def first_role(text: Column, roles: list[tuple[str, list[str]]], otherwise: Column) -> Column:
    out = otherwise
    for name, keys in reversed(roles):
        out = F.when(holds_any(text, keys), name).otherwise(out)
    return out


def table_names(cells: DataFrame) -> DataFrame:
    """Lower-cased column names of each table in order, and its rows."""
    cols = cells.groupBy("table_id", "col_idx").agg(F.lower(F.min("col_name")).alias("name"), F.count("*").alias("n"))
    return cols.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "name"))), lambda s: s["name"]), " ").alias("names"), F.max("n").alias("n_rows"))


def invoice_role(names: Column, n_rows: Column) -> Column:
    hits = F.lit(0)
    for k in LINE_ITEM:
        hits = hits + F.when(F.contains(names, F.lit(k)), 1).otherwise(0)
    return F.when(holds_any(names, HEADER) & (n_rows < 5), "header").when(hits >= 2, "line_items").when(holds_any(names, TOTALS) & (n_rows < 10), "totals").otherwise("unknown")


def technical_role(names: Column, n_rows: Column) -> Column:
    return (
        F.when(holds_any(names, CLIENT) & (n_rows < 5), "client_info").when(holds_any(names, PRODUCT), "products").when(holds_any(names, SERVICE), "services")
        .when(holds_any(names, OPTION), "options").when(holds_any(names, TOTALS) & (n_rows < 10), "totals").when(holds_any(names, TERMS), "terms").otherwise("unknown")
    )


def amount(value: Column) -> Column:
    """Digits, points and commas; a comma is a point; 0 if that is no number."""
    return F.coalesce(F.translate(F.regexp_replace(value, r"[^\d.,]", ""), ",", ".").try_cast("double"), F.lit(0.0))


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin(TRUE_WORDS), F.lit(False))


def normalise_key(key: Column) -> Column:
    bare = F.regexp_replace(F.trim(F.coalesce(key, F.lit(""))), r"(?U)[^\w\s]", "")
    return F.substring(F.lower(F.regexp_replace(bare, r"\s+", "_")), 1, 50)


def term_category(text: Column) -> Column:
    return first_role(F.lower(text), TERM_CATEGORIES, F.lit("general"))


def column_role(name: Column) -> Column:
    return first_role(F.lower(name), COLUMN_ROLES, F.lower(name))


def first_row_fields(cells: DataFrame, fields: list[tuple[str, list[str]]]) -> DataFrame:
    """(table_id, field, value) of a table's first row, fields named by their column; later columns win."""
    rows = cells.filter("row_idx = 0").select("table_id", "col_idx", first_role(F.lower("col_name"), fields, F.col("col_name")).alias("field"), F.coalesce("value", F.lit("")).alias("value"))
    return rows.groupBy("table_id", "field").agg(F.max_by("value", "col_idx").alias("value"))


def line_items(cells: DataFrame) -> DataFrame:
    """One row per table row: description, quantity, price, total, tax. The roles are a fixed list, so the pivot needs no extra pass."""
    role = column_role(F.col("col_name"))
    pick = lambda r: F.max_by("value", F.when(role == r, F.col("col_idx")))
    has = lambda r: F.max(F.when(role == r, 1))
    g = cells.groupBy("table_id", "row_idx").agg(*(pick(r).alias(r) for r, _ in COLUMN_ROLES), *(has(r).alias(f"has_{r}") for r, _ in COLUMN_ROLES))
    numeric = lambda r: F.when(F.col(f"has_{r}") == 1, amount(F.col(r))).alias(r)
    return g.select("table_id", "row_idx", F.when(F.col("has_description") == 1, F.coalesce("description", F.lit(""))).alias("description"), *(numeric(r) for r in ("quantity", "price", "total", "tax")))


def total_label(label: Column) -> Column:
    t = F.trim(F.lower(label))
    return (
        F.when(F.contains(t, F.lit("total")) & F.contains(t, F.lit("ht")), "total_ht").when(F.contains(t, F.lit("total")) & F.contains(t, F.lit("ttc")), "total_ttc")
        .when(holds_any(t, ["tva", "vat", "tax"]), "tax").when(holds_any(t, ["sous", "sub"]), "subtotal").otherwise(t)
    )


def totals(cells: DataFrame) -> DataFrame:
    """(table_id, label, amount): per row the last label and the last amount; a later row wins."""
    name, value = F.lower("col_name"), F.lower(F.coalesce("value", F.lit("")))
    by_name, by_value = holds_any(name, TOTAL_LABEL), holds_any(value, TOTAL_LABEL)
    is_amount = ~by_name & ~by_value & F.coalesce(F.col("value").rlike(r"\d+[,.]\d+"), F.lit(False))
    label = F.when(by_name, F.col("col_name")).when(by_value, F.col("value"))
    g = cells.groupBy("table_id", "row_idx").agg(F.max_by(label, F.when(by_name | by_value, F.col("col_idx"))).alias("label"), F.max_by("value", F.when(is_amount, F.col("col_idx"))).alias("v"), F.max(F.when(is_amount, 1)).alias("has"))
    rows = g.filter("label is not null and has = 1").select("table_id", "row_idx", total_label(F.col("label")).alias("label"), amount(F.col("v")).alias("amount"))
    return rows.groupBy("table_id", "label").agg(F.max_by("amount", "row_idx").alias("amount"))


def terms(cells: DataFrame) -> DataFrame:
    return cells.filter(F.length("value") > 10).select("table_id", "row_idx", "col_idx", F.col("value").alias("text"), term_category(F.col("value")).alias("category"))


def reference(cells: DataFrame) -> DataFrame:
    """Per document the first value in a reference column that looks like a reference."""
    hit = holds_any(F.lower("col_name"), REFERENCE) & F.col("value").rlike(r"(?i)\b[A-Z0-9]{2,}[-/]?[A-Z0-9]{2,}\b")
    return cells.filter(hit).groupBy("doc_id").agg(F.min_by("value", F.struct("table_id", "col_idx", "row_idx")).alias("reference"))


def form_rows(cells: DataFrame) -> DataFrame:
    """Normalised keys, and values with yes and no as true and false."""
    v = F.lower("value")
    return cells.select("table_id", "row_idx", normalise_key(F.col("col_name")).alias("key"), F.when(v.isin("oui", "yes", "true"), "true").when(v.isin("non", "no", "false"), "false").otherwise(F.col("value")).alias("value"))


def _last_by(entries: Column, key: str) -> Column:
    """Entries whose key no later one has."""
    later = lambda x, i: F.exists(F.slice(entries, i + 2, F.size(entries)), lambda y: y[key] == x[key])
    return F.filter(entries, lambda x, i: ~later(x, i))


def _map(entries: Column, key: str, value: str) -> Column:
    plain = F.transform(_last_by(entries, key), lambda x: F.struct(x[key].alias("key"), x[value].alias("value")))
    return F.when(F.size(entries) > 0, F.map_from_entries(plain))


def assemble(cells: DataFrame) -> DataFrame:
    """Per document: header fields, number of items, their total, and totals by label.

    One pass over the cells, summed up by row, then by table, then by document, each within tasks before it moves:
    a row keeps what each of the three kinds of table would take from it, and the table's kind picks.
    """
    role, name, value = column_role(F.col("col_name")), F.lower("col_name"), F.lower(F.coalesce("value", F.lit("")))
    by_name, by_value = holds_any(name, TOTAL_LABEL), holds_any(value, TOTAL_LABEL)
    is_amount = ~by_name & ~by_value & F.coalesce(F.col("value").rlike(r"\d+[,.]\d+"), F.lit(False))
    label = F.when(by_name, F.col("col_name")).when(by_value, F.col("value"))
    field = F.struct("col_idx", first_role(name, HEADER_FIELDS, F.col("col_name")).alias("field"), F.coalesce("value", F.lit("")).alias("value"))
    rows = cells.groupBy("doc_id", "table_id", "row_idx").agg(
        F.array_sort(F.collect_list(F.struct("col_idx", name.alias("name")))).alias("names"),  # a row's columns
        F.max_by("value", F.when(role == "total", F.col("col_idx"))).alias("total"), F.max(role == "total").alias("has_total"),
        F.max_by(label, F.when(by_name | by_value, F.col("col_idx"))).alias("label"), F.max_by("value", F.when(is_amount, F.col("col_idx"))).alias("v"), F.max(is_amount).alias("has_amount"),
        F.array_sort(F.collect_list(F.when(F.col("row_idx") == 0, field))).alias("head"),
    )
    sums = F.when(F.col("label").isNotNull() & F.col("has_amount"), F.struct("row_idx", total_label(F.col("label")).alias("label"), amount(F.col("v")).alias("amount")))
    tables = rows.groupBy("doc_id", "table_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names"), F.count("*").alias("n_rows"),
        F.sum(F.when(F.col("has_total"), amount(F.col("total"))).otherwise(0.0)).alias("total"),
        F.max_by("head", F.when(F.col("row_idx") == 0, 1)).alias("head"), F.array_sort(F.collect_list(sums)).alias("sums"),
    )
    first = F.filter("names", lambda x, i: (i == 0) | (F.element_at("names", F.greatest(i, F.lit(1)))["col_idx"] != x["col_idx"]))
    kind = invoice_role(F.array_join(F.transform(first, lambda x: x["name"]), " "), F.col("n_rows"))
    tables = tables.withColumn("kind", kind)
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    docs = tables.groupBy("doc_id").agg(
        F.sum(of("line_items", "n_rows")).alias("item_count"), F.sum(of("line_items", "total")).alias("total_amount"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "header", F.struct("table_id", "head")))), lambda x: x["head"])).alias("head"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "totals", F.struct("table_id", "sums")))), lambda x: x["sums"])).alias("sums"),
    )
    out = docs.select("doc_id", _map(F.col("head"), "field", "value").alias("header"), "item_count", "total_amount", _map(F.col("sums"), "label", "amount").alias("totals"))
    return out.fillna({"item_count": 0, "total_amount": 0.0})


def kind_counts(cells: DataFrame) -> DataFrame:
    """Products, services and options per document, by the roles of its tables."""
    roles = table_names(cells).select("table_id", technical_role(F.col("names"), F.col("n_rows")).alias("role"), "n_rows")
    docs = cells.select("table_id", "doc_id").distinct()
    count = lambda r: F.coalesce(F.sum(F.when(F.col("role") == r, F.col("n_rows"))), F.lit(0)).alias(r)
    return docs.join(roles, "table_id").groupBy("doc_id").agg(*(count(r) for r in ("products", "services", "options")))


def client_info(cells: DataFrame) -> DataFrame:
    return first_row_fields(cells, CLIENT_FIELDS)


def form_map(rows: DataFrame) -> DataFrame:
    """One map of all form rows of a document; a later table, row or column wins."""
    last = rows.groupBy("doc_id", "key").agg(F.max_by("value", F.struct("table_id", "row_idx")).alias("value"))
    return last.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("fields"))


def section_boxes(sections: DataFrame, boxes: DataFrame) -> DataFrame:
    """(section, ids array) with the first box of each id, in the list's order."""
    first = boxes.groupBy("id").agg(F.min_by("label", "position").alias("label"))
    return sections.select("section", F.posexplode("ids").alias("place", "id")).join(first, "id").select("section", "place", "id", "label")


def document_type_scores() -> dict[str, float]:
    """Even shares: documents carry no sign that is weighed."""
    return {k: 0.25 for k in ("invoice", "technical_quote", "form", "generic")}
