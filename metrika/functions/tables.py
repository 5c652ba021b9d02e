"""Dimension tables of the phonology: symbols, onsets, feature spaces and their distances."""

from __future__ import annotations

import math

# ARPAbet symbols, English onset clusters and articulatory features.
VOWELS = ["AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW"]
CONSONANTS = ["P", "B", "T", "D", "K", "G", "CH", "JH", "F", "V", "TH", "DH", "S", "Z", "SH", "ZH", "HH", "M", "N", "NG", "L", "R", "W", "Y"]
ILLEGAL_ONSETS = ["NG"]
ONSETS_2 = [
    "S P", "S T", "S K", "S M", "S N", "S L", "S W", "S F", "P L", "P R", "P Y", "T R", "T W", "T Y", "K L", "K R", "K W", "K Y", "B L", "B R", "B Y",
    "D R", "D W", "D Y", "G L", "G R", "G W", "F L", "F R", "F Y", "TH R", "TH W", "SH R", "HH Y", "HH W", "V Y", "M Y", "N Y",
]
ONSETS_3 = [
    "S P L", "S P R", "S P Y", "S T R", "S T Y", "S K R", "S K W", "S K Y", "S K L",
]

# Vowel -> (backness, height, rounding) where it begins and, if it glides, where it ends.
VOWEL_POINTS = {
    "IY": [(0.00, 1.00, 0.0)],
    "IH": [(0.20, 0.85, 0.0)],
    "EH": [(0.10, 0.50, 0.0)],
    "AE": [(0.10, 0.20, 0.0)],
    "AH": [(0.50, 0.50, 0.0)],
    "ER": [(0.50, 0.55, 0.0)],
    "AA": [(0.90, 0.00, 0.0)],
    "AO": [(0.90, 0.35, 1.0)],
    "UH": [(0.75, 0.85, 1.0)],
    "UW": [(1.00, 1.00, 1.0)],
    "EY": [(0.10, 0.65, 0.0), (0.20, 0.85, 0.0)],
    "AY": [(0.50, 0.05, 0.0), (0.20, 0.85, 0.0)],
    "OY": [(0.90, 0.35, 1.0), (0.20, 0.85, 0.0)],
    "AW": [(0.50, 0.05, 0.0), (0.75, 0.85, 1.0)],
    "OW": [(0.90, 0.60, 1.0), (0.80, 0.85, 1.0)],
}
RHOTIC = {"ER"}
ROUND_WEIGHT, RHOTIC_WEIGHT, VOICE_WEIGHT = 0.3, 0.5, 0.2
PLACES = {"bilabial": 0.00, "labiovelar": 0.10, "labiodental": 0.15, "dental": 0.25, "alveolar": 0.40, "postalveolar": 0.55, "palatal": 0.70, "velar": 0.85, "glottal": 1.00}
MANNERS = {"stop": 0.00, "affricate": 0.15, "fricative": 0.30, "nasal": 0.55, "liquid": 0.75, "glide": 0.90}
# Consonant -> place, manner, voiced.
CONSONANT_FEATURES = {
    "P": ("bilabial", "stop", False),
    "B": ("bilabial", "stop", True),
    "T": ("alveolar", "stop", False),
    "D": ("alveolar", "stop", True),
    "K": ("velar", "stop", False),
    "G": ("velar", "stop", True),
    "CH": ("postalveolar", "affricate", False),
    "JH": ("postalveolar", "affricate", True),
    "F": ("labiodental", "fricative", False),
    "V": ("labiodental", "fricative", True),
    "TH": ("dental", "fricative", False),
    "DH": ("dental", "fricative", True),
    "S": ("alveolar", "fricative", False),
    "Z": ("alveolar", "fricative", True),
    "SH": ("postalveolar", "fricative", False),
    "ZH": ("postalveolar", "fricative", True),
    "HH": ("glottal", "fricative", False),
    "M": ("bilabial", "nasal", True),
    "N": ("alveolar", "nasal", True),
    "NG": ("velar", "nasal", True),
    "L": ("alveolar", "liquid", True),
    "R": ("postalveolar", "liquid", True),
    "W": ("labiovelar", "glide", True),
    "Y": ("palatal", "glide", True),
}
CONSONANT_POINTS = {c: (PLACES[place], MANNERS[manner], voiced) for c, (place, manner, voiced) in CONSONANT_FEATURES.items()}


def _ends(v: str) -> tuple:
    return VOWEL_POINTS[v][0], VOWEL_POINTS[v][-1]


def is_diphthong(v: str) -> bool:
    return len(VOWEL_POINTS[v]) > 1


def vowel_distance(a: str, b: str) -> float:
    """0 to 1: mean plane distance of both ends, rounding and rhoticity as weighted extras."""
    pairs = list(zip(_ends(a), _ends(b)))
    plane = sum(math.hypot(p[0] - q[0], p[1] - q[1]) for p, q in pairs) / 2
    rounding = sum(abs(p[2] - q[2]) for p, q in pairs) / 2
    raw = plane + ROUND_WEIGHT * rounding + RHOTIC_WEIGHT * ((a in RHOTIC) != (b in RHOTIC))
    return raw / (math.sqrt(2) + ROUND_WEIGHT + RHOTIC_WEIGHT)


def consonant_distance(a: str, b: str) -> float:
    """0 to 1: plane distance of place and manner, voicing as a weighted extra."""
    p, q = CONSONANT_POINTS[a], CONSONANT_POINTS[b]
    return (math.hypot(p[0] - q[0], p[1] - q[1]) + VOICE_WEIGHT * (p[2] != q[2])) / (math.sqrt(2) + VOICE_WEIGHT)


#: Row-major: the engine computes each distance once and looks it up by integer codes.
VOWEL_DISTANCES = [vowel_distance(a, b) for a in VOWELS for b in VOWELS]
CONSONANT_DISTANCES = [consonant_distance(a, b) for a in CONSONANTS for b in CONSONANTS]
