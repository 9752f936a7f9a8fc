"""Evidence tables and items from image annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeloom import dims
from gaugeloom.functions import labels as L
from gaugeloom.functions import text as X


def flatten_coco(document: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO document read as one JSON row."""
    part = lambda c: document.select(F.explode(c).alias("x")).select("x.*")
    return part("images"), part("annotations"), part("categories")


def named_annotations(annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations with category_name (``unknown`` if it has none), an empty bbox and area 0 where they are null."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    joined = annotations.join(names, "category_id", "left")
    return joined.withColumns({"category_name": F.coalesce("category_name", F.lit("unknown")), "bbox": F.coalesce("bbox", F.array().cast("array<double>")), "area": F.coalesce("area", F.lit(0.0))})


def xyxy(bbox):
    """[x, y, w, h] as corners; null unless it has four numbers."""
    b = [F.get(bbox, F.lit(i)) for i in range(4)]
    return F.when(F.size(bbox) == 4, F.array(b[0], b[1], b[0] + b[2], b[1] + b[3]))


def image_evidence(images: DataFrame, annotations: DataFrame, **rule) -> DataFrame:
    """(image_id, labels, has_residual, has_prosthesis, presence_class) of every image, also of those without annotations.

    labels: evidence labels in vocabulary order. rule: words of category names, see ``text.category_parts``.
    """
    label = X.evidence_label(F.col("category_name"), **rule)
    seen = annotations.select("image_id", label.alias("label")).where("label is not null").groupBy("image_id").agg(F.collect_set("label").alias("seen"))
    joined = images.select("image_id").join(seen, "image_id", "left").withColumn("seen", F.coalesce("seen", L.empty()))
    residual = F.exists("seen", lambda x: x.endswith("_residual"))
    prosthesis = F.exists("seen", lambda x: x.endswith("_prosthesis"))
    kind = F.when(residual & prosthesis, "residual_and_prosthesis").when(residual, "residual_only").when(prosthesis, "prosthesis_only").otherwise("none")
    return joined.select("image_id", L.ordered_labels(F.col("seen"), dims.evidence_vocabulary()).alias("labels"), residual.alias("has_residual"), prosthesis.alias("has_prosthesis"), kind.alias("presence_class"))


def usable_instances(instances: DataFrame, min_area: float, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Instances of at least min_area whose width to height lies in [low, high]; no height is out."""
    w, h = F.get("bbox_xywh", F.lit(2)), F.get("bbox_xywh", F.lit(3))
    return instances.where((F.col("area") >= min_area) & (h > 0) & (F.try_divide(w, h) >= low) & (F.try_divide(w, h) <= high))


def option_pool(instances: DataFrame, min_area: float) -> DataFrame:
    """Usable instances with known part as pool entries: opt_%06d in (image, annotation) order, coarse part, xyxy.

    Repeated rows of an annotation are one entry. Ids are dense through sums per image, so no
    task sorts the whole pool.
    """
    from pyspark.sql.window import Window

    part = F.lower(F.trim("part8"))
    known = usable_instances(instances, min_area).withColumn("part8", part).where(part.isin(dims.PART8))
    once = known.groupBy("image_id", "annotation_id").agg(F.min(F.struct("part8", "category_name", "area", "bbox_xyxy")).alias("r"))
    block = F.floor(F.col("image_id") / 4096)
    sizes = once.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row per 4096 images
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("image_id", "annotation_id")) - 1
    numbered = once.withColumn("_b", block).join(before, "_b").withColumn("_i", F.col("_from") + inside)
    return numbered.select(F.concat(F.lit("opt_"), F.lpad(F.col("_i").cast("string"), 6, "0")).alias("option_id"), F.col("image_id").alias("source_image_id"), "annotation_id", "r.part8", F.expr("substring(r.part8, instr(r.part8, '_') + 1)").alias("coarse_part"), "r.category_name", "r.area", "r.bbox_xyxy")


def evidence_queries(evidence: DataFrame, task: str, prompts: list[str], k: int, include_none: bool = False, keep_empty: bool = False) -> DataFrame:
    """One row per image and sampled prompt of the task recognition or attribution, with its gold answer.

    recognition: images without evidence only if include_none. attribution: images without labels
    only if keep_empty, then labelled none.
    """
    from gaugeloom.operators.sampling import sample_prompts

    if task == "recognition":
        options = {v: k for k, v in dims.PRESENCE_CLASSES.items()}
        letter = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
        rows = evidence.where(F.lit(include_none) | (F.col("presence_class") != "none")).select("image_id", F.try_element_at(letter, F.col("presence_class")).alias("target_answer"), L.empty().alias("target_labels"))
        prefix = "presence_img"
    elif task == "attribution":
        rows = evidence.where(F.lit(keep_empty) | (F.size("labels") > 0)).select("image_id", F.lit(None).cast("string").alias("target_answer"), F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("none"))).alias("target_labels"))
        prefix = "segments_img"
    else:
        raise ValueError(f"unknown task: {task}")
    sampled = sample_prompts(rows, prompts, k, "image_id")
    return sampled.select(F.lit(task).alias("task_name"), "image_id", F.concat(F.lit(prefix), F.col("image_id").cast("string")).alias("group_id"), "prompt_id", "prompt", "target_answer", "target_labels")


def items_from_options(options: DataFrame, targets: DataFrame, item: str) -> DataFrame:
    """Items as nested rows: options by letter, right letters, target parts, mode none, single or multiple.

    options: (item, option_id, option_coarse, letter); targets: (item, coarse), one or more per
    item. Items with under two options are left out.
    """
    wanted = targets.groupBy(item).agg(F.array_sort(F.collect_set("coarse")).alias("target_coarse_parts"))
    listed = options.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(F.col("letter").alias("option_id"), F.col("option_id").alias("pool_id"), F.col("option_coarse").alias("coarse_part")))).alias("options"))
    joined = listed.join(wanted, item).where(F.size("options") >= 2)
    right = F.transform(F.filter("options", lambda o: F.array_contains("target_coarse_parts", o["coarse_part"])), lambda o: o["option_id"])
    mode = F.when(F.size("correct") == 0, "none").when(F.size("correct") == 1, "single").otherwise("multiple")
    return joined.withColumn("correct", right).select(item, "options", F.struct(mode.alias("mode"), F.col("correct").alias("correct_option_ids"), "target_coarse_parts", F.size("correct").alias("num_correct")).alias("answer"))


def dataset_statistics(images: DataFrame, annotations: DataFrame, prostheses: DataFrame) -> DataFrame:
    """(statistic, key, n): images, annotations, prostheses, images with prostheses, prostheses by part."""
    one = lambda df, name, n: df.agg(n.cast("long").alias("n")).select(F.lit(name).alias("statistic"), F.lit("").alias("key"), "n")
    count = F.count(F.lit(1))
    part = F.coalesce(F.lower(F.trim("part8")), F.lit("unknown"))
    return (
        one(images, "images", count).unionByName(one(annotations, "annotations", count)).unionByName(one(prostheses, "prostheses", count))
        .unionByName(one(prostheses, "images_with_prostheses", F.count_distinct("image_id")))
        .unionByName(prostheses.groupBy(part.alias("key")).agg(count.alias("n")).select(F.lit("prostheses_by_part").alias("statistic"), "key", "n"))
    )
