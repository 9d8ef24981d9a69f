"""Boxes on pages: overlap, suppression, proximity and size filters, sections and context."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Type factors, thresholds, context patterns and section key words.
TYPE_FACTORS = {"circular": 1.1, "rectangular": 1.0, "symbol": 0.9, "form_widget": 1.2}
MAX_TABLES = 10
OTHER_TYPE, NMS_IOU, MAX_PER_PAGE, MAX_VALID, DENSE_TOTAL = 0.9, 0.5, 30, 40, 100
CONTEXT_PATTERNS = [r"\b(?:oui|non|yes|no)\b", r"\b(?:cocher|check|tick|select)\b", r"[□■☐☑✓✔✕✖✗✘]", r"\[\s*\]|\(\s*\)", r"\b(?:option|choix|choice)\b"]
FORM_SECTIONS = {
    "identification": ["identité", "identification", "identite", "coordonnées", "nom", "prénom", "personne", "patient"],
    "facturation": ["facturation", "facture", "paiement", "prix", "montant", "tarif", "financier"],
    "signature": ["signature", "signer", "approuvé", "validé", "atteste", "certifie"],
    "contact": ["contact", "adresse", "téléphone", "email", "courriel", "portable"],
    "formation": ["formation", "compétence", "diplôme", "certification", "qualification"],
    "experience": ["expérience", "travail", "emploi", "poste", "fonction"],
    "consentement": ["consentement", "accord", "accepte", "approuve", "autorise"],
    "medical": ["médical", "santé", "symptôme", "diagnostic", "traitement", "pathologie"],
    "transport": ["transport", "livraison", "expédition", "véhicule", "automobile", "logistique"],
    "options": ["option", "choix", "préférence", "sélection"],
}
BOX = ["x", "y", "width", "height"]
#: Boxes of a grid cell that one task joins with as many others.
BLOCK_BOXES = 4096


def detection_top_k(boxes: DataFrame, most: int = MAX_TABLES) -> DataFrame:
    """The most confident detections of every page, which is what suppression then sees; ranks are cut within tasks first."""
    w = Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), F.asc("box_id"))
    return boxes.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def iou(a: str, b: str) -> Column:
    """Overlap over union of two boxes given by column prefixes."""
    x = lambda p: F.col(f"{p}x")
    y = lambda p: F.col(f"{p}y")
    w = lambda p: F.col(f"{p}width")
    h = lambda p: F.col(f"{p}height")
    dx = F.greatest(F.lit(0), F.least(x(a) + w(a), x(b) + w(b)) - F.greatest(x(a), x(b)))
    dy = F.greatest(F.lit(0), F.least(y(a) + h(a), y(b) + h(b)) - F.greatest(y(a), y(b)))
    union = w(a) * h(a) + w(b) * h(b) - dx * dy
    return F.when(union > 0, dx * dy / union).otherwise(0.0)


def iou_py(a: dict, b: dict) -> float:
    dx = max(0, min(a["x"] + a["width"], b["x"] + b["width"]) - max(a["x"], b["x"]))
    dy = max(0, min(a["y"] + a["height"], b["y"] + b["height"]) - max(a["y"], b["y"]))
    union = a["width"] * a["height"] + b["width"] * b["height"] - dx * dy
    return dx * dy / union if union > 0 else 0.0


def overlapping(boxes: DataFrame, cell: int = 64, block: int = BLOCK_BOXES) -> DataFrame:
    """Pairs of boxes of a page with any overlap, and their IoU; rows that repeat a box pair like other rows.

    Boxes are dealt to the grid cells they touch and joined on the cell, so a page's boxes are not all paired. Of the cells that two boxes
    share, only the one where their overlap begins gives the pair, so pairs, which may be as many as a page's boxes squared, pass no shuffle.
    A cell's boxes are cut by id into blocks, and two blocks meet in one task, so crowded cells are dealt apart too. The number of
    partitions is explicit: blocks are few bytes and much work, and Spark would put too many into one task.
    """
    key = ["doc_id", "page", "gx", "gy"]
    first = lambda at: F.floor(F.col(at) / cell)
    span = lambda at, size: F.sequence(first(at), F.floor((F.col(at) + F.col(size)) / cell))
    dealt = boxes.filter("width > 0 and height > 0").select("doc_id", "page", "box_id", *BOX, F.explode(span("x", "width")).alias("gx")).select("*", F.explode(span("y", "height")).alias("gy"))
    in_cell = Window.partitionBy(*key)
    block_of = lambda n: F.floor((n - 1) / block)
    dealt = dealt.withColumns({"left": F.col("gx") == first("x"), "top": F.col("gy") == first("y"), "own": block_of(F.row_number().over(in_cell.orderBy("box_id"))), "last": block_of(F.count("*").over(in_cell))})
    # A smaller id is never in a later block, however equal ids are ordered: block i on the left meets blocks j >= i on the right.
    i, j, on = F.sequence(F.lit(0).cast("long"), "own"), F.sequence("own", "last"), [*key, "i", "j"]
    a, b = dealt.select("*", F.col("own").alias("i"), F.explode(j).alias("j")), dealt.select("*", F.explode(i).alias("i"), F.col("own").alias("j"))
    n = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = lambda d, p: d.repartition(n, *on).select(*on, *(F.col(c).alias(f"{p}{c}") for c in ["box_id", *BOX, "left", "top"])).hint("merge")
    begins = [f"least(a_{at} + a_{size}, b_{at} + b_{size}) > greatest(a_{at}, b_{at}) and (a_{edge} or b_{edge})" for at, size, edge in (("x", "width", "left"), ("y", "height", "top"))]
    both = side(a, "a_").join(side(b, "b_"), on).filter(" and ".join(["a_box_id < b_box_id", *begins]))
    return both.select("doc_id", "page", F.col("a_box_id").alias("left_id"), F.col("b_box_id").alias("right_id"), iou("a_", "b_").alias("iou"))


def nms_py(boxes: np.ndarray, scores: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the boxes (x, y, width, height) that stay, best first; ties by id."""
    order = np.lexsort((ids, -scores))
    x1, y1 = boxes[:, 0], boxes[:, 1]
    x2, y2, area = x1 + boxes[:, 2], y1 + boxes[:, 3], boxes[:, 2] * boxes[:, 3]
    keep = []
    while len(order):
        i, rest = order[0], order[1:]
        keep.append(i)
        dx = np.maximum(0, np.minimum(x2[i], x2[rest]) - np.maximum(x1[i], x1[rest]))
        dy = np.maximum(0, np.minimum(y2[i], y2[rest]) - np.maximum(y1[i], y1[rest]))
        order = rest[dx * dy / np.maximum(area[i] + area[rest] - dx * dy, 1e-12) <= threshold]
    return np.array(keep, int)


def nms(boxes: DataFrame, threshold: float = NMS_IOU) -> DataFrame:
    """Greedy suppression per page (a page's boxes are few, and the order matters)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[nms_py(pdf[BOX].to_numpy(float), pdf["confidence"].to_numpy(float), pdf["box_id"].to_numpy(), threshold)]

    return boxes.groupBy("doc_id", "page").applyInPandas(run, boxes.schema)


def sorted_at(column: str, numerator: int, denominator: int) -> Column:
    """The value at a fraction of the sorted list (no interpolation): used per page."""
    listed = F.array_sort(F.collect_list(column))
    return F.element_at(listed, (F.floor(F.size(listed) * numerator / denominator) + 1).cast("int"))


def size_stats(boxes: DataFrame) -> DataFrame:
    return boxes.groupBy("doc_id", "page").agg(F.count("*").alias("n"), *(sorted_at(c, k, 4).alias(f"q{k}_{c}") for c in ("width", "height") for k in (1, 2, 3)))


def quality(boxes: DataFrame) -> DataFrame:
    """Adds quality: confidence times squareness, closeness to the page's median size and a factor of the type; and the page's median size."""
    b = boxes.join(size_stats(boxes).select("doc_id", "page", "n", ((F.col("q2_width") + F.col("q2_height")) / 2).alias("median_size")), ["doc_id", "page"])
    w, h = F.col("width"), F.col("height")
    square = F.when((w > 0) & (h > 0), 1 - F.least(F.abs(1 - w / h), F.lit(0.6)) * 1.5).otherwise(0.0)
    alike = F.greatest(F.lit(0.0), 1 - F.abs((w + h) / 2 - F.col("median_size")) / F.col("median_size"))
    factor = F.lit(OTHER_TYPE)
    for k, v in TYPE_FACTORS.items():
        factor = F.when(F.col("type") == k, v).otherwise(factor)
    return b.withColumn("quality", F.col("confidence") * square * alike * factor)


def proximity_filter(boxes: DataFrame) -> DataFrame:
    """Boxes without near neighbours of better quality, in two passes per page; pages of five boxes or fewer stay whole."""
    rated, names = quality(boxes), boxes.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) <= 5:
            return pdf[names]
        near = max(pdf["median_size"].iloc[0] * 0.75, 25)
        pdf = pdf.sort_values(["quality", "box_id"], ascending=[False, True])
        taken, kept = [], []

        def pick(low: float, reach: float, most: int | None) -> None:
            for i, r in enumerate(pdf.itertuples()):
                if r.quality > low and i not in kept and not any(abs(r.x - x) < reach and abs(r.y - y) < reach for x, y in taken):
                    taken.append((r.x, r.y))
                    kept.append(i)
                    if most and len(kept) >= most:
                        return

        pick(0.75, near, None)
        pick(0.5, near * 0.9, MAX_PER_PAGE)
        return pdf.iloc[kept][names]

    return rated.groupBy("doc_id", "page").applyInPandas(run, boxes.schema)


def has_box_context(context: Column) -> Column:
    out = F.lit(False)
    for p in CONTEXT_PATTERNS:
        out = out | context.rlike(p)
    return out


def post_validate(boxes: DataFrame) -> DataFrame:
    """Confidence, size fences, context and aspect rules; at most forty per page stay."""
    b = boxes.join(size_stats(boxes), ["doc_id", "page"]).filter("confidence >= 0.55")
    w, h = F.col("width"), F.col("height")

    def inside(c: str) -> Column:
        span = F.col(f"q3_{c}") - F.col(f"q1_{c}")
        return (F.col(c) >= F.greatest(F.lit(8), F.col(f"q1_{c}") - 2 * span)) & (F.col(c) <= F.least(F.lit(50), F.col(f"q3_{c}") + 2 * span))

    aspect = F.when(h > 0, w / h).otherwise(0.0)
    relaxed = aspect.between(0.7, 1.4) & (F.least(w, h) >= 7) & (F.greatest(w, h) <= 60)
    context = F.coalesce("text_context", F.lit(""))
    marked = has_box_context(context)
    confidence = F.when(context == "", F.col("confidence")).when(marked, F.least(F.lit(1.0), F.col("confidence") * 1.2)).otherwise(F.col("confidence") * 0.95)
    b = b.filter((inside("width") & inside("height")) | relaxed).filter(aspect.between(0.65, 1.55))
    b = b.withColumn("low", (context != "") & ~marked & (confidence < 0.52)).withColumn("confidence", confidence).filter("not low")
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), F.asc("box_id")))
    return b.withColumn("rn", rank).filter(F.col("rn") <= MAX_VALID).select(*boxes.columns)


def cap_dense(boxes: DataFrame, total: int = DENSE_TOTAL, per_page: int = MAX_PER_PAGE) -> DataFrame:
    """Documents of more than ``total`` boxes keep the most confident of each page."""
    n = boxes.groupBy("doc_id").agg(F.count("*").alias("n_doc"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.desc("confidence"), F.asc("box_id")))
    return boxes.join(n, "doc_id").withColumn("rn", rank).filter((F.col("n_doc") <= total) | (F.col("rn") <= per_page)).drop("n_doc", "rn")


def form_section(text: Column) -> Column:
    """Section with most key words, the first of equals; empty if there is none."""
    t = F.lower(text)
    votes = []
    for i, (name, keys) in enumerate(FORM_SECTIONS.items()):
        n = F.lit(0)
        for k in keys:
            n = n + F.when(F.contains(t, F.lit(k)), 1).otherwise(0)
        votes.append(F.struct(n.alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["name"]).otherwise("")


def context_meaningful(context: Column) -> Column:
    c = F.coalesce(context, F.lit(""))
    letters = F.length(F.regexp_replace(c, r"(?U)[^\p{L}]", ""))
    special = F.length(F.regexp_replace(c, r"(?U)[\p{L}\p{N}\s]", ""))
    return (F.length(F.regexp_replace(c, r"(?U)[^\w]", "")) >= 3) & c.rlike(r"(?U)\b[a-zA-Z]{3,}\b") & (letters > 0) & (special / (letters + 1) <= 0.7)


def images_near_text(images: DataFrame, blocks: DataFrame, most: int = 100) -> DataFrame:
    """Images of a page with a text block at most so far above or below (y0, y1 of both)."""
    b = blocks.groupBy("doc_id", "page", "y0", "y1").count().select("doc_id", "page", F.col("y0").alias("t0"), F.col("y1").alias("t1"))
    near = F.least(F.abs(F.col("y0") - F.col("t1")), F.abs(F.col("t0") - F.col("y1"))) <= most
    return images.join(b, ["doc_id", "page"]).filter(near).select(*images.columns).distinct()


def form_values(boxes: DataFrame) -> DataFrame:
    """Per document its labels with their state (the most confident box of a label decides), and labels by section."""
    best = boxes.groupBy("doc_id", "label").agg(F.max_by("is_checked", F.struct("confidence", -F.col("box_id"))).alias("is_checked"), F.max_by("section", F.struct("confidence", -F.col("box_id"))).alias("section"))
    return best.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "is_checked")))).alias("form_values"), F.array_sort(F.collect_set("section")).alias("sections"))


def box_report(boxes: DataFrame) -> DataFrame:
    """Boxes, checked share and confidence bands per document."""
    band = lambda lo, hi: F.count_if((F.col("confidence") >= lo) & (F.col("confidence") < hi))
    return boxes.groupBy("doc_id").agg(F.count("*").alias("n_boxes"), F.round(F.avg(F.col("is_checked").cast("int")), 6).alias("checked_ratio"), band(0, 0.6).alias("low"), band(0.6, 0.8).alias("medium"), band(0.8, 1.01).alias("high"))


def grid_cells(contours: DataFrame, least: int = 20) -> DataFrame:
    """Contours large enough, numbered from top to bottom and left to right."""
    w = Window.partitionBy("doc_id", "page").orderBy("y", "x", "box_id")
    return contours.filter((F.col("width") >= least) & (F.col("height") >= least)).withColumn("cell_no", F.row_number().over(w))
