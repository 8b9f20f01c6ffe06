"""The queries of this subpackage and their SQL, by name."""

from . import chat, collocations, decontaminate, language, mixing, neighbours, ngram_join, pii, runs, secrets, toxicity, url_filters, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_url_filters": url_filters.op2,
    "op3_ngram_join": ngram_join.op3,
    "op4_neighbours": neighbours.op4,
    "op5_language_id": language.op5,
    "op6_toxicity": toxicity.op6,
    "op7_mixing": mixing.op7,
    "op8_secret_scans": secrets.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_chat_formatting": chat.op10,
    "op11_collocations": collocations.op11,
    "op12_pii": pii.op12,
    "op13_periodic_runs": runs.op13,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_secret_scans": secrets.OP8_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
