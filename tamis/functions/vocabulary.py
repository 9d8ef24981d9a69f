"""Vocabulary of metal construction, as look-up rows and as tags of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States of the business processes, standards, steel grades and profile sizes.
STATES = {
    "devis": ["brouillon", "en_attente", "validé", "refusé", "expiré"],
    "commande": ["brouillon", "confirmée", "en_production", "en_attente_matériaux", "en_fabrication", "prête", "livrée"],
    "fabrication": ["planifiée", "en_cours", "contrôle_qualité", "terminée"],
    "pose": ["à_planifier", "planifiée", "en_cours", "réceptionnée"],
}
PAPERS = {
    "devis": ["chiffrage", "avant_metré", "note_technique"],
    "commande": ["bon_commande", "plan_exécution", "fiche_débit"],
    "fabrication": ["gamme_fabrication", "plan_atelier", "fiche_autocontrôle"],
    "pose": ["plan_pose", "pv_réception", "dossier_sécurité"],
}
STANDARDS = {
    "construction": ["NF EN 1090-1", "NF EN 1090-2", "NF EN 1993", "DTU 32.1"],
    "matériaux": ["NF EN 10025", "NF EN 10219"],
    "soudage": ["NF EN ISO 3834", "NF EN ISO 9606-1"],
    "surface": ["NF EN ISO 1461", "NF EN ISO 12944", "NF EN ISO 2063"],
}
GRADES = {"S235": 235, "S275": 275, "S355": 355}
PROFILES = {
    "IPE": [80, 100, 120, 140, 160, 180, 200, 220, 240, 270, 300, 330, 360, 400, 450, 500, 550, 600],
    "HEA": [100, 120, 140, 160, 180, 200, 220, 240, 260, 280, 300, 320, 340, 360, 400, 450, 500, 550, 600],
    "HEB": [100, 120, 140, 160, 180, 200, 220, 240, 260, 280, 300, 320, 340, 360, 400, 450, 500, 550, 600],
    "UPN": [80, 100, 120, 140, 160, 180, 200, 220, 240, 260, 280, 300],
}


def rows(spark: SparkSession) -> DataFrame:
    """(kind, class, place, term): a fixed table, small enough to broadcast anywhere."""
    out = [(kind, group, i, str(t)) for kind, table in (("state", STATES), ("paper", PAPERS), ("standard", STANDARDS), ("profile", PROFILES)) for group, terms in table.items() for i, t in enumerate(terms)]
    out += [("grade", "steel", i, g) for i, g in enumerate(GRADES)]
    return spark.createDataFrame(out, "kind string, class string, place int, term string")


def standards_in(text: Column) -> Column:
    """Groups of the standards that a text names."""
    hits = []
    for group, names in STANDARDS.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(text, F.lit(n))
        hits.append(F.when(hit, group))
    return F.array_compact(F.array(*hits))


def profiles_in(text: Column) -> Column:
    """Profiles of standard size that a text names (``IPE 200``, ``HEA200``)."""
    found = F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(PROFILES)})\s?(\d{{2,3}})\b"), 0)
    known = [f"{k}{n}" for k, sizes in PROFILES.items() for n in sizes]
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\s", "")), lambda x: x.isin(known)))
