"""Column contracts of the source files. The spellings and orders are fixed values of the file formats."""

GEO = ["provinsi", "kabupaten", "kecamatan", "kelurahan"]
PARTIES = [
    "pkb", "gerinda", "pdip", "golkar", "nasdem", "garuda", "berkarya", "pks", "perindo", "ppp",
    "psi", "pan", "hanura", "demokrat", "pa", "sira", "pda", "pna", "pbb", "pkpi",
]
COUNTS = ["total-pemilih", "total-pengguna", "suara-total", "suara-sah", "suara-tidak-sah"]
CONTEST_COLUMNS = ["id", *GEO, "tps", "timestamp", *PARTIES, *COUNTS, *(f"c1-{i}" for i in range(1, 7))]
DONOR_COLUMNS = ["id", *GEO, "tps", "timestamp", "pemilih-1", "pemilih-2", *COUNTS, "c1-1", "c1-2"]
HIERARCHY_COLUMNS = ["kodeprov", "namaprov", "kodekab", "namakab", "kodekec", "namakec"]
COPY_FIELDS = ["pemilih-1", "pemilih-2", *COUNTS]
#: The columns of the per-province presidential exports, and what their count columns are elsewhere.
EXPORT_COLUMNS = ["provinsi", "kabupaten", "kecamatan", "kelurahan", "id_wilayah", "id_tps", "pas1", "pas2", "sah", "tSah", "jum"]
EXPORT_NAMES = {"pas1": "pemilih-1", "pas2": "pemilih-2", "sah": "suara-sah", "tSah": "suara-tidak-sah", "jum": "suara-total"}
#: Ballot order and short labels of the options.
CONTEST_OPTIONS = {"pemilih-1": "Jokowi–Ma'ruf", "pemilih-2": "Prabowo–Sandi"}
PARTY_OPTIONS = {
    "pkb": "PKB", "gerinda": "Gerindra", "pdip": "PDI-P", "golkar": "Golkar", "nasdem": "NasDem", "garuda": "Garuda", "berkarya": "Berkarya", "pks": "PKS", "perindo": "Perindo", "ppp": "PPP",
    "psi": "PSI", "pan": "PAN", "hanura": "Hanura", "demokrat": "Demokrat", "pa": "PA", "sira": "SIRA", "pda": "PDA", "pna": "PNA", "pbb": "PBB", "pkpi": "PKPI",
}
