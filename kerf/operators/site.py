"""Owners of items among plan types (LKP-12), excavation (QTY-9), roles and uses of floors (AGG-59)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerf.functions import geometry

#: Kinds of items that each plan type tells, in the order in which owners are looked for. Fixed values.
PRODUCED = {
    "sta_kat_kalip": "beton kalip demir kalip_iskelesi plywood beton_pompaj",
    "sta_temel_kalip": "beton kalip demir grobeton kazi temel_su_yalitimi",
    "sta_temel_donati": "demir",
    "sta_doseme_donati": "demir hasir_celik",
    "sta_kolon": "demir",
    "sta_kiris": "demir",
    "sta_perde": "demir",
    "sta_merdiven": "beton kalip demir",
    "mim_kat_plani": "duvar siva boya kapi pencere cam",
    "mim_doseme_kaplama": "sap seramik_zemin doseme_kaplama derz_dolgu supurgelik laminat",
    "mim_tavan": "asma_tavan tavan_siva_boya tavan_profili aski_teli",
    "mim_cephe": "cephe_brut mantolama cephe_boya kompozit_panel giydirme_cephe",
    "mim_cati": "kenet_cati cati_membran cati_kiremit cati_sandvic_panel celik_cati cati_oluk",
    "mim_dograma": "kapi pencere dograma cam",
    "mim_prekast": "prekast_panel prekast_montaj",
    "elk_aydinlatma": "armatur acil_aydinlatma anahtar buat",
    "elk_kuvvet": "priz kablo boru pano",
    "elk_tava": "tava tava_aski tava_ek",
    "elk_zayif": "kamera data_prizi yangin_dedektor hoparlor kartli_gecis data_kablo",
    "elk_topraklama": "topraklama",
    "elk_genel": "armatur priz anahtar kablo boru pano",
    "mek_sihhi": "klozet lavabo pisuar batarya yer_suzgeci boru_pprc_temiz boru_pvc",
    "mek_isitma": "radyator fancoil vrf_ic_unite boru_bakir boru_celik boru_izolasyon",
    "mek_hav": "hava_kanal menfez damper fan kanal_izolasyon",
    "mek_yangin": "sprinkler yangin_boru yangin_dolabi yangin_vana",
    "alt_altyapi": "boru_koruge kum_yatak geri_dolgu bordur asfalt parke_tas",
    "pey_peyzaj": "cim agac cali bitki_topragi sulama_boru peyzaj_doseme",
    "asn_asansor": "asansor asansor_montaj",
}
#: Uses whose floors are handed over as a shell ('' is not known), and the one that does not make a project mixed. Fixed values.
SHELL, SOCIAL, ATTIC_RANK = ("ticari", ""), "sosyal", 98


def foreign_owner(items: DataFrame, produced: dict[str, str] | None = None) -> DataFrame:
    """LKP-12: items (plan_type, code, ...) with `owner`, the first other plan type that tells the item's kind.

    A kind belongs to a plan type that has it or a beginning of it up to an underscore. '' where the plan type is not
    known, tells the kind itself, or nobody does. The codes' beginnings are joined by equality, never compared in pairs.
    """
    produced = PRODUCED if produced is None else produced
    rules = [(p, place, kind) for place, (p, kinds) in enumerate(produced.items()) for kind in kinds.split()]
    table = items.sparkSession.createDataFrame(rules, "teller string, place int, produced string")
    code = F.lower(F.coalesce(items["code"], F.lit("")))
    parts = F.split(code, "_")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    kinds = items.select(code.alias("kind"), begins.alias("begins")).distinct().select("kind", F.explode("begins").alias("produced"))
    told = kinds.join(F.broadcast(table), "produced").groupBy("kind").agg(F.min_by("teller", "place").alias("first"), F.collect_set("teller").alias("tellers"))
    own = items["plan_type"]
    free = F.coalesce(~own.isin(*produced), F.lit(True)) | F.array_contains(told["tellers"], own)
    return items.join(told, code == told["kind"], "left").select(*[items[c] for c in items.columns], F.when(free, "").otherwise(F.coalesce(told["first"], F.lit(""))).alias("owner"))


def offset_area(points: Column, off: Column) -> Column:
    """Area of a convex outline widened by off with sharp corners: A + P * off + off^2 * sum of tan(turn / 2)."""
    at = lambda i: F.get(points, F.pmod(i, F.size(points)))

    def turn(i: Column) -> Column:
        a, b, c = at(i - 1), at(i), at(i + 1)
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        below = F.hypot(ux, uy) * F.hypot(vx, vy) + ux * vx + uy * vy
        return F.when(below > 0, F.abs(ux * vy - uy * vx) / below).otherwise(0.0)

    turns = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(points) - 1), turn), F.lit(0.0), lambda s, v: s + v)
    return geometry.area(points) + geometry.perimeter(points) * off + off * off * turns


def excavation(pits: DataFrame, default_work: float = 0.6) -> DataFrame:
    """QTY-9: of each pit (points or null, area, depth, margin, note_work, own_work, slope) its volume, working space
    and where that comes from.

    A margin given by the user multiplies area and depth. Otherwise the outline is widened by the working space at the
    bottom and by the slope up to the top, and the volume is Simpson's between them; without an outline, area times depth.
    The working space is the drawing's, the project's or the default. Pits that touch are measured each by itself.
    """
    has = F.coalesce(F.size("points") >= 3, F.lit(False)) & (geometry.area(F.col("points")) > 0)
    given = F.coalesce(F.col("margin") > 0, F.lit(False))
    work = F.coalesce(F.when(F.col("note_work") > 0, F.col("note_work")), F.when(F.col("own_work") > 0, F.col("own_work")), F.lit(default_work))
    source = F.when(F.col("note_work") > 0, "drawing").when(F.col("own_work") > 0, "param").otherwise("default")
    wide = F.greatest(F.coalesce("slope", F.lit(0.0)), F.lit(0.0)) * F.col("depth")
    simpson = F.col("depth") / 6 * (offset_area(F.col("points"), work) + 4 * offset_area(F.col("points"), work + wide / 2) + offset_area(F.col("points"), work + wide))
    return pits.select(
        *[pits[c] for c in pits.columns if c not in ("points", "volume", "work", "work_source")],
        F.when(given, F.col("area") * F.col("depth") * F.col("margin")).when(has, simpson).otherwise(F.col("area") * F.col("depth")).alias("volume"),
        F.when(~given & has, work).alias("work"),
        F.when(given, "param").when(has, source).otherwise("default").alias("work_source"),
    )


def floor_role(rank: Column) -> Column:
    """AGG-59: part that a floor plays where a shell is handed over: attic, basement or '' (a shop floor, or not known)."""
    return F.when(rank == ATTIC_RANK, "attic").when(rank < 0, "basement").otherwise("")


def usage_summary(floors: DataFrame) -> DataFrame:
    """AGG-59: of each project (floors: project_id, block, rank, usage) its uses, floors by use, whether it is mixed, and
    how many floors of a block are handed over whole."""
    use = F.coalesce("usage", F.lit(""))
    per = floors.groupBy("project_id", use.alias("usage")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("rank").isNotNull(), F.struct(F.upper(F.trim(F.coalesce("block", F.lit("")))), "rank"))).alias("whole"))
    named = F.when(F.col("usage") != "", F.struct("usage", "n"))
    summary = F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: F.concat(x["usage"], F.lit(": "), x["n"].cast("string"))), ", ")
    mixed = F.count(F.when(~F.col("usage").isin("", SOCIAL), 1)) > 1
    return per.groupBy("project_id").agg(summary.alias("summary"), mixed.alias("mixed"), F.coalesce(F.sum(F.when(~F.col("usage").isin(*SHELL), F.col("whole"))), F.lit(0)).alias("whole_floors"))
