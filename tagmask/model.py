"""Names and orders of the data model. Every table carries `dossier_id`; documents are one row each."""

#: The categories in their order.
CATEGORIES = ("PERSONA", "AZIENDA", "INDIRIZZO", "EMAIL", "TELEFONO", "CF", "PIVA", "IBAN", "DATA", "IMPORTO", "PRATICA", "CATASTO")
#: Categories of which two writings may mean one thing.
NAMED = ("PERSONA", "AZIENDA")
APPLIED, NOT_FOUND, DISABLED = "APPLIED", "NOT_FOUND", "DISABLED"
DRAFT, PENDING, APPROVED = "DRAFT", "PENDING_REVIEW", "APPROVED"
#: Priorities when spans overlap; smaller wins.
PRIORITY = {"CF": 1, "IBAN": 1, "PIVA": 1, "EMAIL": 2, "TELEFONO": 2, "CATASTO": 2, "PRATICA": 2, "DATA": 3, "IMPORTO": 3, "PERSONA": 4, "AZIENDA": 4, "INDIRIZZO": 4}
#: The pattern of a placeholder, and of anything that looks like a damaged one.
STRICT, PERMISSIVE = r"\[[A-Z]+_[0-9]+\]", r"\[[A-Za-z]+[_\-\s]?[0-9]*\]?"
#: Documents that a dossier takes, bytes of an upload.
MAX_DOCUMENTS, MAX_BYTES = 10, 32 * 1024 * 1024
#: Fixed values of the scan verdict of a page: fewer characters and a larger share of images than these.
MIN_CHARS, MAX_IMAGE_SHARE = 40, 0.5
