"""Labels of files in public data sets, told by their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Types of passports in a public set of documents, extensions of its images, and parts of names of annotations.
DOCUMENT_TYPES = ("aze_passport", "grc_passport", "lva_passport", "srb_passport")
DOCUMENT_IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
ANNOTATIONS = ("mask", "segm", "markup", "groundtruth", "annotation")
#: Folders of a selfie set with the attack that they hold, and extensions of its images.
ATTACK_FOLDERS = {
    "live_user_provided": "live_selfie", "spoof_screen_replay": "screen_replay", "spoof_print_paper": "print_paper_or_cardboard_mask", "spoof_mask_cutout": "mask_or_cutout", "spoof_unknown": "unknown_spoof",
}
SELFIE_IMAGES = ("jpg", "jpeg", "png", "webp", "bmp")
#: Beginnings of file names, the set they come from, and the attack that they show, if not the folder's.
NAME_PREFIXES = (
    ("axon_display_replay", "AxonData/Display_replay_attacks", "screen_replay"),
    ("axon_print_paper", "AxonData/print-cardboard-mask-face-spoofing", "print_paper_or_cardboard_mask"),
    ("axon_large_", "AxonData/face-anti-spoofing-dataset", None),
)
OWN_SOURCE = "user_provided"


def _has_extension(path: Column, extensions: tuple[str, ...]) -> Column:
    return F.lower(F.substring_index(path, "/", -1)).rlike(rf".\.(?:{'|'.join(extensions)})$")


def document_type(path: Column) -> Column:
    """The first of the known types that the whole path names, hyphens counting as underscores; null if none."""
    plain = F.replace(F.lower(path), F.lit("-"), F.lit("_"))
    return F.coalesce(*(F.when(F.contains(plain, F.lit(t)), t) for t in DOCUMENT_TYPES))


def document_images(files: DataFrame, path: str = "path") -> DataFrame:
    """files with `document_type`: images of a known type whose own names don't tell of annotations."""
    name = F.lower(F.substring_index(F.col(path), "/", -1))
    rows = files.where(_has_extension(F.col(path), DOCUMENT_IMAGES) & ~name.rlike("|".join(ANNOTATIONS)))
    return rows.withColumn("document_type", document_type(F.col(path))).where("document_type is not null")


def selfie_labels(files: DataFrame, relative: str = "relative") -> DataFrame:
    """files with expected (live, spoof), attack_type and source, for images below the known folders.

    The folder is the first part of the path; a file's own name tells its source, and its attack, before the folder does.
    """
    folder, name = F.substring_index(relative, "/", 1), F.substring_index(relative, "/", -1)
    by_folder = F.coalesce(*(F.when(folder == f, a) for f, a in ATTACK_FOLDERS.items()))
    first = lambda pick: F.coalesce(*(F.when(name.startswith(p), F.lit(pick(s, a))) for p, s, a in NAME_PREFIXES))
    rows = files.where(folder.isin(*ATTACK_FOLDERS) & F.contains(F.col(relative), F.lit("/")) & _has_extension(F.col(relative), SELFIE_IMAGES))
    return rows.withColumns({
        "expected": F.when(folder.startswith("live"), "live").otherwise("spoof"), "attack_type": F.coalesce(first(lambda s, a: a), by_folder), "source": F.coalesce(first(lambda s, a: s), F.lit(OWN_SOURCE)),
    })
