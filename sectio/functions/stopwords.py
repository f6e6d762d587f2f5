"""Word classes that delimit candidate phrases, per language.

--- fixed values: closed-class word lists (lower case) ---
"""

PREPOSITIONS = {
    "en": ["of", "in", "on", "at", "by", "for", "with", "from", "to", "into", "during", "after", "before",
           "between", "among", "within", "without", "over", "under", "through", "per", "versus", "vs",
           "via", "about", "against", "across", "along", "around", "toward", "towards", "upon", "beyond",
           "following", "throughout", "than"],
    "fr": ["de", "du", "des", "à", "au", "aux", "en", "dans", "par", "pour", "sur", "sous", "avec", "sans",
           "entre", "chez", "vers", "pendant", "après", "avant"],
    "de": ["von", "vom", "zu", "zum", "zur", "mit", "nach", "bei", "aus", "in", "im", "an", "am", "auf",
           "für", "über", "unter", "vor", "zwischen", "durch", "gegen", "ohne", "während"],
    "es": ["de", "del", "a", "al", "en", "con", "por", "para", "sin", "sobre", "entre", "desde", "hasta",
           "durante", "tras", "contra", "hacia", "según"],
}

DETERMINERS = {
    "en": ["the", "a", "an", "this", "that", "these", "those", "its", "their", "his", "her", "our", "your",
           "my", "each", "every", "all", "any", "some", "no", "both", "either", "neither", "such"],
    "fr": ["le", "la", "les", "l", "un", "une", "ce", "cet", "cette", "ces", "son", "sa", "ses", "leur",
           "leurs", "notre", "nos", "chaque"],
    "de": ["der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "einem", "einer", "eines",
           "dieser", "diese", "dieses", "jeder", "jede", "jedes", "sein", "seine", "ihr", "ihre"],
    "es": ["el", "la", "los", "las", "un", "una", "unos", "unas", "este", "esta", "estos", "estas", "ese",
           "esa", "su", "sus", "cada"],
}

OTHER_STOPWORDS = {
    "en": ["and", "or", "but", "nor", "yet", "so", "is", "are", "was", "were", "be", "been", "being", "am",
           "has", "have", "had", "having", "do", "does", "did", "will", "would", "can", "could", "may",
           "might", "shall", "should", "must", "it", "they", "we", "he", "she", "i", "you", "them", "us",
           "him", "me", "which", "who", "whom", "whose", "what", "where", "when", "how", "why", "not",
           "as", "if", "then", "also", "there", "here", "very", "more", "most", "less", "least", "only",
           "too", "just", "while", "because", "however", "therefore", "thus", "although", "though",
           "whether", "other", "same", "whereas", "since", "until", "unless", "again", "further", "once",
           "few", "many", "much", "own", "itself", "themselves"],
    "fr": ["et", "ou", "mais", "donc", "or", "ni", "car", "est", "sont", "était", "être", "a", "ont",
           "avait", "il", "elle", "ils", "elles", "nous", "vous", "je", "tu", "on", "qui", "que", "quoi",
           "dont", "où", "ne", "pas", "plus", "se", "si", "comme", "aussi", "très"],
    "de": ["und", "oder", "aber", "denn", "sondern", "ist", "sind", "war", "waren", "sein", "hat",
           "haben", "hatte", "wird", "werden", "er", "sie", "es", "wir", "ich", "du", "man", "der", "wer",
           "was", "wo", "wie", "nicht", "kein", "keine", "auch", "sehr", "noch", "als", "wenn", "dass", "so"],
    "es": ["y", "o", "pero", "ni", "es", "son", "era", "ser", "fue", "ha", "han", "había", "él", "ella",
           "ellos", "ellas", "nosotros", "yo", "tú", "se", "que", "quien", "donde", "como", "no", "más",
           "muy", "también", "si", "lo", "le", "les"],
}

LANGS = list(PREPOSITIONS)
