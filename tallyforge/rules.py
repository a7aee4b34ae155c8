"""Word lists, patterns and vocabularies.

Fixed values: results depend on these exact words and patterns.
"""

# fmt: off
# Money words, English and French.
FINANCIAL_KEYWORDS = (
    "invoice", "facture", "quote", "quoting", "soumission", "devis", "estimate", "estimat", "receipt", "quittance", "payment", "paiement", "deposit", "acompte", "contract", "contrat", "change order", "purchase", "bon de",
    "sales", "billing", "cost", "budget", "financ", "material", "materiel", "contractor", "entrepreneur", "sub quote", "order", "sow", "scope of work", "proposal", "milestone", "retainage", "holdback", "work package", "bid", "tender", "$",
)
OBLIGATION_KEYWORDS = ("contract", "agreement", "payment", "deadline", "penalty", "deposit", "due", "lease", "warranty", "contrat", "entente", "paiement", "bail")
CONTRACT_MIMES = ("application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/vnd.google-apps.document")
FINANCIAL_MIMES = (*CONTRACT_MIMES, "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel", "application/vnd.google-apps.spreadsheet", "text/csv", "text/plain")
MODEL_NAME = r"(?i)acquisition model|multifamily acquisition|pro-?forma|\bproforma\b|projection|scoring model|pipeline tracker|broker directory|cruncher|study notes|valuation|underwriting|cmhc|\bmefq\b|red roof|green roof"
NON_FINANCIAL = r"(?i)\bphoto|\bdrawing|\bplan view|\brendering"
ROLLUP_NAME = r"(?i)\bcosts\b|costing|cost tracker|\btracker\b|payment log|\blisting\b|breakdown|etat de compte|état de compte|statement of account|contractors ?\+ ?material|contractors and material|\bbudget\b|projection|job costing"
PROJECTION_CONTENT = r"(?i)total project projection|current project overview|\bproject projection\b|\bpro ?forma\b|\birr\b|\bnoi\b|\bcap rate\b|net operating income|market report|valeur marchande|market value|projected investment|total investment|feasibility|appraisal|as-stabilized|future value|development cost|\bdev cost\b"
BUYOUT = r"(?i)quittance|buy-?out|settlement|termination|transaction et quittance|\btenant\b|locataire"
LEASE = r"(?i)\blease\b|\bbail\b|loyer|rental"
CONFIRMED_ROLES = ("invoice", "receipt")
STANDALONE_TYPES = ("markup", "contingency", "tax", "deposit", "adjustment", "other")
STREET_WORDS = ("rue", "av", "ave", "avenue", "chemin", "ch", "blvd", "boul", "boulevard")
CONTRACT_NAME = r"(?i)contract|agreement|contrat|entente"
TAX_TERM = r"(?i)\b(tax|taxes|tps|tvq|gst|qst|hst)\b"
PRETAX = r"(?i)pre.?tax|sub.?total|grand"
AFTERTAX = r"(?i)after.?tax"
CONTINGENCY = r"(?i)conting"
MARKUP = r"(?i)\b(ohp|overhead|profit|o&p|markup)\b"
GRID_TAX = r"(?i)\b(tax|tps|tvq|gst|qst|hst)\b"
EXTRAS_MARKERS = ("extras", "change order", "co #", "co#")
JOBCOST_MARKERS = ("material spending", "job cost", "job costing", "costing", "spending")
ORDER_MARKERS = ("order quantities", "qty per pack", "door order", "order sheet")
QUOTE_MARKERS = ("accepted quote", "estimate", "quote")
EXTRAS_ACCEPTED = r"(?i)\baccepted\b|\baccepte(e|s|es)?\b|\bapproved\b|\bapprouve(e|s|es)?\b|\bdone\b|\bcomplet\w*\b|\bfait\b|\brealise(e|s|es)?\b|\btermine(e|s|es)?\b"
EXTRAS_PROPOSED = r"(?i)\bproposed?\b|\bpropose(e|s|es)?\b|\bnot\s+started\b|\bpending\b|\bin\s+progress\b|\ben\s+cours\b|\ben\s+attente\b|\bquoted\b|\bdevis\b|\bsoumis(e|es)?\b|\bopen\b"
EXTRAS_REJECTED = r"(?i)\bnot\s+accepted\b|\bnon\s+accepte(e|s|es)?\b|\brejected\b|\brejete(e|s|es)?\b|\brefus\w*\b|\bcancell?ed\b|\bannul\w*\b|\bvoided?\b|\babandonn\w*\b|\bn/?a\b"
STOPWORDS = ("the", "and", "for", "of", "to", "in", "on", "is", "it", "at", "by", "an", "or", "be", "as", "with", "from", "that", "this", "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "au", "aux", "pour", "sur", "par", "dans")
TASK_STATUS_SCORES = {"IN_PROGRESS": 1.0, "BLOCKED": 0.95, "TODO": 0.55, "DONE": 0.1}
STATUS_LABELS = {"working on it": "IN_PROGRESS", "in progress": "IN_PROGRESS", "stuck": "BLOCKED", "blocked": "BLOCKED", "done": "DONE", "completed": "DONE", "cancelled": "CANCELLED", "todo": "TODO", "future steps": "TODO", "on hold": "TODO"}
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "jfif", "heic", "heif", "bmp", "tif", "tiff")
PDF_EXTENSIONS = ("pdf", "doc", "docx")
AUTO_CLAIM_TYPES = ("labour_time", "attendance_only")
#: Division code, name, and words that mark a text as belonging to it; in order of precedence.
DIVISIONS = (
    ("01", "General Requirements", ("general requirements", "overhead", "profit", "o&p", "ohp", "contingency", "contingence", "supervision", "site supervision", "delivery", "livraison", "mobilization", "permit", "permis", "frais generaux", "administration", "general conditions")),
    ("02", "Demolition", ("demolition", "demo", "teardown", "removal", "remove", "enlevement", "stripping", "gutting")),
    ("03", "Concrete", ("concrete", "beton", "foundation", "fondation", "slab", "dalle", "footing", "semelle")),
    ("05", "Structural", ("structural", "structure", "steel", "acier", "beam", "poutre", "load-bearing", "load bearing", "lintel", "linteau", "column", "colonne", "joist", "solive")),
    ("22", "Plumbing", ("plumbing", "plomberie", "plumber", "plombier", "rough-in plumbing", "pex", "drain", "sink", "evier", "toilet", "toilette", "shower", "douche", "faucet", "robinet", "water heater", "chauffe-eau", "sanitary", "sanitaire")),
    ("23", "HVAC / Mechanical", ("hvac", "mechanical", "mecanique", "heating", "chauffage", "ventilation", "air conditioning", "climatisation", "heat pump", "thermopompe", "ductwork", "conduit", "furnace", "fournaise", "hrv", "vrc")),
    ("26", "Electrical", ("electrical", "electrique", "electricite", "electrician", "electricien", "wiring", "cablage", "lighting", "eclairage", "outlet", "prise", "panel", "panneau", "breaker", "disjoncteur")),
    ("08", "Openings (Doors/Windows)", ("opening", "door", "porte", "window", "fenetre", "glazing", "vitrage", "skylight", "puits de lumiere")),
    ("07", "Roofing / Insulation / Moisture", ("roof", "roofing", "toiture", "insulation", "isolation", "waterproofing", "impermeabilisation", "membrane", "thermal", "vapor barrier", "pare-vapeur", "soffit", "fascia")),
    ("06", "Carpentry / Millwork", ("carpentry", "charpenterie", "menuiserie", "millwork", "framing", "ossature", "wood", "bois", "trim", "moulding", "moulure", "baseboard", "plinthe")),
    ("09", "Finishes", ("finishes", "finitions", "drywall", "gypse", "gypsum", "plaster", "platre", "flooring", "plancher", "floor", "tile", "tuile", "carrelage", "paint", "painting", "peinture", "grout", "coulis", "ceiling", "plafond")),
    ("10-12", "Fixtures / Hardware / Casework", ("fixture", "hardware", "quincaillerie", "cabinetry", "cabinet", "armoire", "casework", "countertop", "comptoir", "vanity", "vanite", "specialty", "furnishing", "appliance", "electromenager", "accessory", "accessoire")),
    ("31-32", "Site / Landscape / Earthwork", ("excavation", "landscape", "landscaping", "earthwork", "grading", "paving")),
)
UNCLASSIFIED = ("99", "Unclassified")
# fmt: on
