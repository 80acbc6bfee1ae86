"""Object classes and label vocabularies used by the rules."""

RULE_VEHICLES = ["car", "truck", "bus", "motorcycle", "bicycle"]
ANOMALY_VEHICLES = ["car", "truck", "bus", "motorcycle", "vehicle", "bicycle"]
TRACK_VEHICLES = ["vehicle", "car", "truck", "motorcycle"]
LOOMING_VEHICLES = ["car", "vehicle", "truck", "bus", "motorcycle"]
VANDALISM_OBJECTS = ["car", "vehicle", "truck", "bus", "motorcycle", "object", "motion"]
TRACK_NON_OBJECTS = ["person", "vehicle", "car", "truck", "motorcycle", "motion"]
LOITERING_TYPES = ["person", "vehicle", "car"]
SUPPRESSING_VEHICLES = ["car", "truck", "bus"]
OPEN_VOCAB_SUPPRESSORS = ["car", "truck", "bus", "vehicle", "person"]
TWO_WHEELERS = ["bicycle", "motorcycle"]
NOT_AN_OBJECT = ["motion", "unknown", "none", ""]

DETECTOR_CLASSES = [
    "person", "car", "truck", "bus", "motorcycle", "bicycle",
    "backpack", "suitcase", "handbag", "dog", "boat",
]

LABEL_ALIASES = {
    "people": "person",
    "a person": "person",
    "motorbike": "motorcycle",
    "a motorcycle": "motorcycle",
    "bike": "bicycle",
    "a bicycle": "bicycle",
    "phone": "cell phone",
    "mobile phone": "cell phone",
    "smartphone": "cell phone",
    "purse": "handbag",
    "a handbag": "handbag",
    "a backpack": "backpack",
    "a suitcase": "suitcase",
    "a bottle": "bottle",
    "water bottle": "bottle",
    "a car": "car",
    "a truck": "truck",
    "a bus": "bus",
}

SECURITY_WORDS = [
    "theft", "steal", "stolen", "robbery", "thief", "suspect", "flee", "fleeing",
    "escape", "intruder", "intrusion", "loitering", "prowling", "break-in", "disappear",
    "disappeared", "removal", "running", "sprint", "getaway", "vehicle", "crash", "impact",
]

INCIDENT_TAGS = [
    "LOITERING", "PROWLING", "FLEEING", "COORDINATION", "CONVERGENCE",
    "ASSET", "DISAPPEARANCE", "BREACH",
]
