"""Names of numbered codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of signature types, as listings print them.
SIGNATURE_TYPES = {
    0x00: "signature of binary document",
    0x01: "signature of canonical text document",
    0x02: "Standalone signature",
    0x10: "Generic certification of a User ID and Public Key packet",
    0x11: "Persona certification of a User ID and Public Key packet",
    0x12: "Casual certification of a User ID and Public Key packet",
    0x13: "Positive certification of a User ID and Public Key packet",
    0x18: "Subkey Binding Signature",
    0x19: "Primary Key Binding Signature",
    0x1F: "Signature directly on a key",
    0x20: "Key revocation signature",
    0x28: "Subkey revocation signature",
    0x30: "Certification revocation signature",
    0x40: "Timestamp signature",
    0x50: "Third-Party Confirmation signature.",
}

# Names of packet tags.
PACKET_TAGS = {
    1: "Public-Key Encrypted Session Key Packet",
    2: "Signature Packet",
    3: "Symmetric-Key Encrypted Session Key Packet",
    4: "One-Pass Signature Packet",
    5: "Secret Key Packet",
    6: "Public Key Packet",
    7: "Secret Subkey Packet",
    8: "Compressed Data Packet",
    9: "Symmetrically Encrypted Data Packet",
    10: "Marker Packet",
    11: "Literal Data Packet",
    12: "Trust Packet",
    13: "User ID Packet",
    14: "Public Subkey Packet",
    17: "User Attribute Packet",
}

# Letters of public-key algorithms.
ALGORITHM_LETTERS = {1: "R", 2: "r", 3: "s", 16: "g", 17: "D", 18: "e", 19: "E", 20: "G", 22: "E"}

# Bits by curve, the object id in hex.
CURVE_BITS = {
    "2B81040023": 521,
    "2B81040022": 384,
    "2A8648CE3D030107": 256,
    "2B2403030208010107": 256,
    "2B240303020801010B": 384,
    "2B240303020801010D": 512,
    "2B8104000A": 256,
    "2B06010401DA470F01": 256,
    "2B060104019755010501": 256,
}


def label(code: Column, names: dict, default: str = "unknown") -> Column:
    """The name of a code, or ``default``: an expression over a literal map, no join."""
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    return F.coalesce(F.try_element_at(table, code), F.lit(default))


def signature_type(code: Column) -> Column:
    return label(code, SIGNATURE_TYPES, "UNEXPECTED SIGTYPE")


def algorithm_letter(code: Column) -> Column:
    """One letter for a public-key algorithm, ``?`` for others."""
    return label(code, ALGORITHM_LETTERS, "?")
