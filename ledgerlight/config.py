"""Thresholds and word lists of the rules. Results depend on them as they stand."""

from __future__ import annotations

SEVERITIES = ("low", "medium", "high", "critical")
WEIGHTS = {"critical": 40, "high": 25, "medium": 12, "low": 5}
ALERT = 40
BANDS = ((70, "High"), (40, "Medium"))
ERA_CUTOFF = "2023-04-01"

COST_OUTLIER = {"rule_id": "A-COST-01", "z": 2.5, "least_group": 8, "least_pct": 30.0, "least_excess": 100_000, "percentile": 0.975, "mismatch": 20.0}
EXPENDITURE = {"rule_id": "A-EXP-01", "z": 3.0, "least_group": 8}
PEER_PROFILE = {"rule_id": "A-PEER-01", "z": 3.0, "least_features": 2, "least_group": 30}
COMPLETION = {"rule_id": "R-TIME-01", "days": 365, "outer_days": 548}
COST_CEILING = {"rule_id": "R-COST-01", "least": 250_000, "most": 25_000_000, "district_works": 10}
SANCTION = {"rule_id": "R-SANC-01", "days": 45, "district_works": 10, "pattern_id": "R-SANC-02", "pattern_works": 20}
REPAIR = {"rule_id": "R-REPAIR-01", "cap": 5_000_000, "category": "Repair and Renovation", "words": ("repair", "renovation", "renovate", "marammat")}
TRUST = {"rule_id": "R-TRUST-01", "cap": 5_000_000, "category": "Trust and Society"}
SCST = {"rule_id": "R-SCST-01", "sc": 15.0, "st": 7.5}
SCST_PROXY = {"rule_id": "R-SCST-02", "sc": 15.0, "st": 7.5, "least_spent": 50_000_000, "least_seats": 1}
SPIKE = {"rule_id": "R-SPIKE-01", "low": 40.0, "spike": 65.0, "years": 2, "ratio": 2.0}
PILEUP = {"rule_id": "R-PILE-01", "most_pct": 50.0, "years": 3}
DUPLICATE = {"rule_id": "D-DUP-01", "cosine": 0.80, "fuzzy": 88, "radius_km": 2.0, "cross_era": 0.05, "batch": 3, "amount_pct": 10, "typo": 85, "body": 90, "photo_bits": 6, "boilerplate_pct": 2.0, "specific": 3, "neighbours": 5, "per_work": 2, "least_chars": 15}
GENERIC_CLUSTER = {"rule_id": "D-DUP-02", "least": 8, "specific": 3}
NETWORK = {"rule_id": "N-NET-01", "z": 2.0, "least_works": 5, "share": 0.5, "districts": 4, "spread_actors": ("vendor", "district_authority")}
PAYMENTS = {"before": "P-SEQ-01", "late": "P-LATE-01", "late_days": 180, "repeated": "P-DUP-01", "material": 100_000}
REVISIONS = {"place": "V-REV-01", "bulk": 50, "amount": "V-AMT-01", "least_pct": 10.0, "least_abs": 100_000, "year_end_days": 15, "agency": "V-IA-01", "vendor": "V-VEN-01", "paid": "V-PAY-01", "paid_abs": 1000, "listed": "V-LIST-01", "often": "V-FREQ-01", "history_days": 90, "revised_works": 200, "least_revisions": 3, "times": 3.0}

PLACE_FIELDS = ("description", "category", "work_type", "district", "state", "constituency")
AMOUNT_FIELDS = ("sanctioned_amount", "estimated_cost")

#: Asset terms and the paragraph each indicates.
ASSETS = {
    "temple": "5.2.11", "mandir": "5.2.11", "mosque": "5.2.11", "masjid": "5.2.11", "church": "5.2.11", "gurudwara": "5.2.11", "gurdwara": "5.2.11", "religious": "5.2.11", "idol": "5.2.11",
    "welcome gate": "5.2.12", "swagat dwar": "5.2.12", "swagat dwaar": "5.2.12", "gate of honour": "5.2.12",
    "residential building": "5.2.2", "residential quarters": "5.2.2", "commercial establishment": "5.2.3",
}
ACTIVITIES = {
    "maintenance of": "5.2.1", "operation and maintenance": "5.2.1", "land acquisition": "5.2.7", "acquisition of land": "5.2.7", "compensation for land": "5.2.7", "grants and loans": "5.2.5",
    "relief fund": "5.2.6", "reimbursement": "5.2.8", "unauthorised colony": "5.2.13", "unauthorized colony": "5.2.13", "recurring expenditure": "5.2.14",
}
PERMISSIBLE = (
    "road street lane path pathway marg drain drainage culvert bridge hall bhavan bhawan room school college library toilet light lights lighting mast pole well borewell tubewell handpump tank pond park ground "
    "stadium shed wall fence platform centre center building complex crematorium ghat bus shelter water pipeline anganwadi dispensary hospital ambulance vehicle computer book books furniture equipment sadak sadk "
    "rasta raasta marga pcc cc rcc kharanja kharnja interlocking nali naali naala kuva kuan kuwa talab samudayik chabutra chabutara shauchalay pulia puliya boring hentpump paniki tanki vidyalaya aanganwadi "
    "chardiwari boundary prakash streetlight"
).split()
VERBS = r"\b(construction|constructing|construct|const\.?|renovation|renovate|repair(?:ing)?|building|build|purchase|procurement|installation|installing|providing|provision|setting\s+up|erection|upgradation|improvement|development|laying)\b\s*(?:of\s+|for\s+)?"
PLACE_WORDS = r"\b(at|near|nearby|opposite|opp|from|to|towards|toward|beside|behind|adjacent|adjoining|in|into|on|under|within|around|infront|in\s+front|ward|village|gram|panchayat|block|mandal|tehsil|taluk|district|gp|colony|nagar|basti|road\s+no|ref)\b"
SECULAR = r"\b(shishu|vidya|vidhya|saraswati|bal|balak|gyan|shiksha|sanskar|samaj|samaaj|rang|rangam|natya|kala|krida|yuvak)\s*(mandir|mandira|mandiram)\b"
LOCATIVE = r"^\s*(?:n[iaeou]|k[aeiou]|no|nu)?\s*(?:ke\s+(?:pas|paas|paass|nikat|samip|samne|nazdik|bagal|piche|aas[\s-]?pas|ass[\s-]?pass)|ki\s+taraf|se\s|se$|tak\b|pase\b|paas\b|pas\b|par\b|thi\b|sudhi\b|najik\b|javal\b|shejari\b|wali\b|wale\b)"
LOCAL_BODY = r"(^|[^a-z])(g\.?\s?p\.?|gram\s*panch\w*|grampanch\w*|village\s*panch\w*|panch(a?y?a?t|yat|ayt)h?\w*|nagar\s*(palika?|palik|panch\w*|nigam|nigan|parishad|parisad)|municipal\w*|janpad|(zil+a|jila)\s*(parishad|panch\w*)|mandal\s*parishad|sarpanch)([^a-z]|$)"
VILLAGE_BODY = r"(^|[^a-z])(g\.?\s?p\.?|gram\s*panch\w*|grampanch\w*|village\s*panch\w*|sarpanch)([^a-z]|$)"
#: What a title leaves out of a description.
NOISE = (
    r"as per (the )?attached( letter| list)?", "attached letter", "continued? work",
    "continue work", "balance work", "as per estimate", "as per (the )?list",
    r"under mplads?( fund[s]?)?", r"mplads? fund[s]?", r"work order no\.?\s*\S*",
)
