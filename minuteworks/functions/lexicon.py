"""Word lists, phrases and patterns.  Fixed values: results depend on them, and data that are stored already hold them."""

# Segments that are noise when they are the whole segment.
NOISE_EXACT = ("terima kasih", "terima kasih banyak", "like dan subscribe", "thank you", "kiitos", "gracias", "subscribe", "please subscribe", "...")
# Segments that are noise when they start with one of these.
NOISE_PREFIXES = (
    "terima kasih telah menonton",
    "terima kasih sudah menonton",
    "terima kasih telah menyaksikan",
    "thank you for watching",
    "thanks for watching",
    "jangan lupa like",
    "jangan lupa subscribe",
    "sampai jumpa di video",
    "kiitos kun katsoit",
    "gracias por ver",
)
# Thanks that people say in meetings: noise only beside other noise.
SPOKEN_THANKS = ("terima kasih", "terima kasih banyak")
# Phrases counted as signs of invented text.
INVENTED = (
    "terima kasih telah menonton",
    "terima kasih sudah menonton",
    "sampai jumpa di video",
    "jangan lupa subscribe",
    "like dan subscribe",
    "thank you for watching",
    "thanks for watching",
    "selamat beristirahat dan selamat bekerja",
)
# Warnings that need no review.
ADVISORY = ("track_imbalance:", "mic_clipping_advisory:", "mic_overrun_advisory:", "mic_missing_advisory:")
# Upper-case words that are structure, not facts.
STRUCTURAL = (
    "ACTION", "ACTIONS", "CHAPTER", "CONSIDERATIONS", "CONTEXT", "DECISION", "DECISIONS", "DETAIL", "DETAILS", "FORMAT", "H1", "H2", "H3",
    "ITEM", "KEY", "NOTE", "OUTPUT", "PART", "POINT", "POINTS", "SECTION", "SUMMARY", "TOPIC", "TOPICS", "TRANSCRIPT",
)
BLOCKING_ISSUES = ("empty", "truncated", "marker_mismatch", "repetition_loop", "runaway_paragraph", "generation_artifact", "malformed_action_items")
FALLBACK_ISSUES = ("empty", "truncated", "marker_mismatch")
MARKER = r"\[\[ASSET_\d+\]\]"
ACTION_WORDS = r"(?i)(?<![A-Za-z0-9_])(?:akan|harus|perlu|target|besok|malam ini|minggu depan|dalam \d+ hari|fix|perbaiki|membuat|diminta|coba|will|must|need|tomorrow|next week|follow up)(?![A-Za-z0-9_])"
FILLER = r"(?i)^(?:halo|tes|oke|iya|ya|terima kasih|thank you)[.!?\s]*$|^sampai jumpa(?![A-Za-z0-9_])"

# ---- fixed values of note checks: patterns and word lists that decide what is found
BAR = r"(?<![A-Za-z0-9_])"
END = r"(?![A-Za-z0-9_])"
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
TEXT_UNIT = r"\[\[ASSET_\d+\]\]|[^\S\r\n]+|[\r\n]+|(?:(?!\[\[ASSET_\d+\]\])\S)+"
SENTENCE_END = r"(?:\r?\n){2,}|[.!?][\"')\]]*(?:[ \t]+|\r?\n+)"
TRANSCRIPT_HEADING = r"\s*#{1,6}\s+(?:\d+(?:\.\d+)*\.[ \t]+)?(?:Transcript Lengkap|Complete Transcript)\s*"
PLACEHOLDER_BODY = rf"(?i)^(?:tidak ada|belum ada|no|none){END}.*{BAR}(?:keputusan|decisions?|tindak lanjut|action items?|follow-?ups?){END}|^(?:no explicit action items?|nothing to follow up){END}"
LEAD_IN = r"(?i)^\(?\s*(?:catatan|note|notes|nb|disclaimer|keterangan)\s*[:.\-—]"
SUBJECT = rf"(?i){BAR}(?:transkrip\w*|transcript\w*|audio|rekaman|recording){END}"
JUDGEMENT = rf"(?i){BAR}(?:kualitas|kurang|buruk|bising|terpotong|sulit|quality|poor|unclear|unintelligible|garbled|incomplete|truncated|noisy|noise){END}"
HEDGE = rf"(?i){BAR}(?:sebagian|beberapa bagian|some parts?|portions?){END}.*{BAR}(?:tidak jelas|kurang jelas|sulit didengar|unclear|inaudible|unintelligible|perkiraan|approximat|estimat){END}"
ORDINALS = r"(?im)^\s*(?:[-*+]\s*)?\d+(?:[.,]\d+)*(?=[.)]\s)|^(?:\s*(?:#{1,6}\s*)?(?:part|section|chapter|item)\s*)\d+(?:[.,]\d+)*(?=[\s:.)-]*$)"
NUMBER = r"(?<![\p{L}\p{N}_])\d+(?:[.,]\d+)*(?:%|m|km)?(?![\p{L}\p{N}_])"
ACRONYM = r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)*(?![A-Za-z0-9_])"
BETWEEN_REPEATS = r"[\s,;:.*+\-]+"
ARTIFACT = r"(?i)(?<![A-Za-z0-9_])(?:stop|continue) generating(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])as an ai(?![A-Za-z0-9_])|\*\(stop generating filler\)\*|\s->\s"
GENERIC_TITLE = r"(?i)^(?:recording|voice recording|meeting|meeting notes?|recording notes?|progress meeting|catatan rekaman|catatan|catatan rapat|rapat|rekaman)(?:\s*[-–—:]\s*.*)?$"
# A placeholder stands between brackets of one kind.
PLACEHOLDER_NAME = r"(?:tanggal|date|main topic|topic|judul|title)"
PLACEHOLDER_TITLE = rf"(?i)\[{PLACEHOLDER_NAME}\]|\{{{PLACEHOLDER_NAME}\}}|<{PLACEHOLDER_NAME}>"
TALK = rf"(?i)^(?:berapa|kenapa|mengapa|gimana|bagaimana|siapa|kapan|di mana|dimana|apakah|kok|nah|jadi|terus|lalu|tadi){END}"
ORDINAL_TITLE = rf"(?i)^(?:pertanyaan|bagian|poin|topik|sesi|bab|part|section|question|point|topic|chapter)\s+(?:\d+|pertama|kedua|ketiga|keempat|kelima|keenam|one|two|three|four|five|first|second|third){END}"
DANGLING = rf"(?i){BAR}(?:dan|atau|dengan|untuk|tentang|terkait|mengenai|mencakup|meliputi|berdasarkan|melalui|serta|and|or|with|for|about|including|based on|through)\s*$"
TITLE_STOP_WORDS = (
    "yang", "dan", "atau", "dari", "untuk", "pada", "dengan", "dalam", "ini", "itu", "the", "and", "for", "from", "with", "this", "that",
    "meeting", "rapat", "catatan", "recording", "rekaman", "progress", "progres",
)
TOPIC_STOP_WORDS = (
    "yang", "dan", "atau", "dari", "untuk", "pada", "dengan", "dalam", "ini", "itu", "the", "and", "for", "from", "with", "this", "that",
    "meeting", "rapat", "catatan", "recording", "rekaman", "pembahasan", "diskusi", "update", "status", "data", "sistem", "system", "format", "teknis", "technical",
)
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "id": ("Januari", "Februari", "Maret", "April", "Mei", "Juni", "Juli", "Agustus", "September", "Oktober", "November", "Desember"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
}
# Day, month and year, in this order as arguments.
DATE_SHAPES = {"en": "%2$s %1$s, %3$s", "id": "%1$s %2$s %3$s", "de": "%1$s. %2$s %3$s", "fr": "%1$s %2$s %3$s", "es": "%1$s de %2$s de %3$s"}
# Warning, and headings of summary, points and follow-ups, of extractive notes.
EXTRACTIVE_LABELS = {
    "en": (
        "> AI formatting was unavailable. What follows was picked from the transcript, sentence by sentence, and nothing was added.",
        "Extractive Summary",
        "Key Points",
        "Mentioned Follow-ups",
    ),
    "id": (
        "> Pemformatan AI tidak tersedia. Kalimat berikut dipilih dari transkrip apa adanya, tanpa tambahan.",
        "Ringkasan Ekstraktif",
        "Poin Utama",
        "Tindak Lanjut yang Disebutkan",
    ),
}
# Headings and table columns of structured notes.
STRUCTURED_LABELS = {
    "en": ("Summary", "Key Points", "Decisions", "Action Items", "Action", "Owner", "Deadline"),
    "id": ("Ringkasan", "Poin Utama", "Keputusan", "Tindak Lanjut", "Tindakan", "Pemilik", "Tenggat Waktu"),
}
