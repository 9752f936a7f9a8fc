"""Fixed values of the evaluation domain."""

# Answer options of the presence task and the class each stands for.
PRESENCE_CLASSES = {"a": "residual_only", "b": "prosthesis_only", "c": "residual_and_prosthesis", "d": "none"}

# Body parts with side, and without.
PART8 = ["left_arm_upper", "left_arm_lower", "right_arm_upper", "right_arm_lower", "left_leg_upper", "left_leg_lower", "right_leg_upper", "right_leg_lower"]
COARSE_PARTS = ["arm_upper", "arm_lower", "leg_upper", "leg_lower"]

# Words of a category name for a segment, by coarse part.
SEGMENT_WORDS = {"upper-arm": "upper_arm", "forearm": "forearm", "thigh": "thigh", "calf": "calf"}
SEGMENT_PART = {"upper_arm": "arm_upper", "forearm": "arm_lower", "thigh": "leg_upper", "calf": "leg_lower"}

# Option letters, none aliases, variants with their key metric and gate default.
LETTERS = list("ABCDEFGH")
NONE_ALIASES = ["", "abstain", "cannot be determined", "empty", "n/a", "no visible cue", "none", "none of the above", "none_visible", "not visible", "unsure"]
VARIANTS = {
    "presence": ("exact_accuracy", True),
    "attribution_constrained": ("set_miou", True),
    "compatibility_diversity": ("avg_f1", False),
    "compatibility_category": ("hit_at_1", False),
    "attribution_freeform": ("set_miou", True),
}


def evidence_vocabulary(with_none: bool = False) -> list[str]:
    """The sixteen labels segment_side_kind: residual ones in segment order, then prosthesis ones."""
    labels = [f"{segment}_{side}_{kind}" for kind in ("residual", "prosthesis") for segment in SEGMENT_PART for side in ("l", "r")]
    return labels + ["none"] if with_none else labels


def coarse_of(part8: str) -> str:
    """Part without its side; an unknown part is an error."""
    if part8 not in PART8:
        raise ValueError(f"unknown part: {part8}")
    return part8.split("_", 1)[1]


def hard_negatives(coarse: str) -> list[str]:
    """Other segments of the same limb."""
    limb = coarse.split("_")[0]
    return [c for c in COARSE_PARTS if c.startswith(limb) and c != coarse]


def cross_limb(coarse: str) -> list[str]:
    """Segments of the other limb."""
    limb = coarse.split("_")[0]
    return [c for c in COARSE_PARTS if not c.startswith(limb)]
