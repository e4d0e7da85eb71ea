"""Lists and tables that decide results and must keep their order."""

# Substring that marks a failed prediction, and the two failure labels.
ERROR_MARK = "Error"
ERROR_PROCESSING = "Error_Processing"
ERROR_MODEL_LOAD = "Error_Model_Load"

# Architecture families, tested in this order.
FAMILY_KEYWORDS = {
    "CNNs": ["resnet", "efficientnet", "mobilenet", "vgg", "densenet", "inception", "convnext"],
    "Transformers": ["vit", "swin", "deit", "cait", "eva"],
    "Vision-Language": ["clip", "siglip", "blip", "align"],
}

# Model type by keyword, tested in this order.
MODEL_TYPE_RULES = [
    ("siglip", "siglip"),
    ("clip", "clip"),
    ("mobilevit", "unknown"),
    ("vit", "vit"),
    ("resnet", "resnet"),
    ("efficientnet", "efficientnet"),
]

# Where a model config states its type.
MODEL_TYPE_PATHS = ["$.model_type", "$.architectures[0]"]

# Names under which pretrained backbones are published.
BACKBONE_ALIASES = {
    "resnet-50": "resnet50.a1_in1k",
    "resnet_50": "resnet50.a1_in1k",
    "resnet50": "resnet50.a1_in1k",
    "efficientnet-b0": "efficientnet_b0.ra_in1k",
    "efficientnet_b0": "efficientnet_b0.ra_in1k",
}

# Assumed mean power draw in watts.
ASSUMED_WATTS = {
    "ResNet50": 45.0,
    "EfficientNet-B0": 18.0,
    "ConvNeXt-Tiny": 42.0,
    "ViT-B-16": 50.0,
    "Swin-T": 44.0,
    "MobileViT-S": 12.0,
    "DenseNet121": 22.0,
    "ShuffleNet-V2": 8.0,
    "MobileNet-V3": 10.0,
}

# Consensus share in five bins, closed on the left; upper edges.
CONSENSUS_EDGES = [0.2, 0.4, 0.6, 0.8, 1.01]
CONSENSUS_BINS = ["0–20%", "20–40%", "40–60%", "60–80%", "80–100%"]

# Agreement percent in three bins, closed on the right; upper edges.
AGREEMENT_EDGES = [50.0, 99.9, 100.0]
AGREEMENT_BINS = ["Low (<50%)", "Majority (50-99%)", "Full (100%)"]

# Weight of accuracy and of inverse latency per scenario.
SCORE_WEIGHTS = {
    "score_accuracy_priority": (0.7, 0.3),
    "score_balanced": (0.5, 0.5),
    "score_edge_priority": (0.3, 0.7),
}

# Fixed value: guard added to a divisor that may be zero.
EPSILON = 1e-6

# Fixed value: text that stands for a missing number.
MISSING_NUMBER_MARKS = ["—"]

# Fixed value: code points of every character that Unicode counts as white space.
WHITE_SPACE_CODES = [
    *range(0x09, 0x0E),
    *range(0x1C, 0x21),
    0x85,
    0xA0,
    0x1680,
    *range(0x2000, 0x200B),
    0x2028,
    0x2029,
    0x202F,
    0x205F,
    0x3000,
]
