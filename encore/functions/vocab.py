"""The word lists, country lists and mappings the rules are defined over.

They are data, kept together in their natural order; every rule takes its list
as a parameter and defaults to the one here.
"""

# Vietnamese letters with diacritics, by base letter.
VI_A = "àáạảãâầấậẩẫăằắặẳẵ"
VI_E = "èéẹẻẽêềếệểễ"
VI_I = "ìíịỉĩ"
VI_O = "òóọỏõôồốộổỗơờớợởỡ"
VI_U = "ùúụủũưừứựửữ"
VI_Y = "ỳýỵỷỹ"
VI_D = "đ"
VI_LETTERS = VI_A + VI_E + VI_I + VI_O + VI_U + VI_Y + VI_D

# Name patterns counted by the linguistic score.
VI_FAMILY_NAMES = ["nguyen", "tran", "le", "pham", "hoang", "phan", "vu", "dang", "bui", "do", "ho", "ngo", "duong", "ly"]
VI_KNOWN_NAMES = ["son tung", "my tam", "dam vinh hung", "ho ngoc ha", "noo phuoc thinh"]

# Artist indicators of the name classifier.
VI_INDICATORS = ["buitruonglinh", "vsoul", "khói", "đen", "mck", "obito"]

# Genre vocabularies.
VI_GENRES = [
    "vietnamese pop", "vpop", "v-pop", "vietnamese rock", "vietnamese folk", "vietnamese traditional", "ca tru",
    "quan ho", "cai luong", "cheo", "vietnamese indie", "vietnamese r&b", "vietnamese rap", "vietnamese hip hop",
]
WESTERN_GENRES = [
    "pop", "rock", "hip hop", "rap", "country", "folk", "blues", "jazz", "classical", "electronic", "dance", "house",
    "techno", "indie", "alternative", "punk", "metal", "r&b", "soul", "reggae",
]
BRIDGE_GENRES = [
    "world music", "fusion", "world fusion", "asian pop", "k-pop", "mandopop", "cantopop", "international", "crossover",
]

# Market codes.
ASIAN_MARKETS = ["VN", "SG", "MY", "TH", "ID", "PH"]
WESTERN_MARKETS = ["US", "GB", "CA", "AU", "DE", "FR", "IT", "ES", "NL", "SE"]

# Location rule lists.
VN_COUNTRIES = ["VN", "VIETNAM"]
WESTERN_COUNTRIES = ["US", "GB", "CA", "AU", "DE", "FR", "IT", "ES", "NL", "SE", "NO", "DK"]
VN_IP_PREFIXES = [
    "14.", "27.", "42.", "43.", "45.", "49.", "58.", "59.", "60.", "61.", "62.", "103.", "113.", "115.", "116.",
    "117.", "118.", "119.", "120.", "121.", "123.", "124.", "125.", "171.", "210.", "222.",
]

# Ordered substring rules (substrings, label).
PLATFORM_RULES = [
    (["ios", "iphone"], "iOS"), (["android"], "Android"), (["windows"], "Windows"), (["macos", "mac"], "macOS"),
    (["web", "browser"], "Web"),
]
REASON_RULES = [
    (["playlist"], "Playlist"), (["album"], "Album"), (["artist"], "Artist"), (["search"], "Search"),
    (["radio"], "Radio"), (["recommendation"], "Recommendation"), (["shuffle"], "Shuffle"),
]

# Artist lists of the regex flags.
VI_PATTERN_ARTISTS = [
    "buitruonglinh", "RAP VIỆT", "W/N", "Khói", "VSOUL", "SOOBIN", "Hà Anh Tuấn", "Only C", "tofutns", "tlinh", "MCK",
    "Obito",
]
WESTERN_PATTERN_ARTISTS = ["Ariana Grande", "Drake", "The Weeknd", "Taylor Swift", "Post Malone"]

# Artist and word lists of the keyword votes.
VI_VOTE_ARTISTS = [
    "buitruonglinh", "den vau", "hoang thuy linh", "son tung", "my tam", "duc phuc", "erik", "jack", "k-icm", "chi pu",
    "min", "amee", "justatee", "rhymastic", "binz", "karik", "suboi", "phan manh quynh",
]
WESTERN_VOTE_ARTISTS = [
    "taylor swift", "ed sheeran", "bruno mars", "ariana grande", "justin bieber", "billie eilish", "drake", "dua lipa",
    "adele", "sam smith", "christina grimmie", "austin mahone", "shawn mendes", "charlie puth", "maroon 5", "ron pope",
]
VI_WORDS = ["em", "anh", "yeu", "con", "khong", "noi", "tim"]
EN_WORDS = ["the", "and", "of", "you", "me", "my", "love", "is"]

# The longer lists of the capped keyword votes.
VI_CAPPED_ARTISTS = [*VI_VOTE_ARTISTS, "vu cat tuong", "toc tien", "bao thy"]
WESTERN_CAPPED_ARTISTS = [
    "taylor swift", "ed sheeran", "bruno mars", "ariana grande", "justin bieber", "billie eilish", "drake",
    "the weeknd", "dua lipa", "adele", "sam smith", "john legend", "alicia keys", "beyonce", "rihanna",
    "christina grimmie", "austin mahone", "shawn mendes", "charlie puth", "maroon 5",
]
CHINESE_ARTISTS = [
    "邓紫棋", "周杰伦", "林俊杰", "王力宏", "张学友", "陈奕迅", "李荣浩", "薛之谦", "毛不易", "华晨宇", "张杰",
    "林宥嘉", "石白其", "苏星婕",
]
VI_CAPPED_WORDS = ["em", "anh", "yeu", "con", "khong", "noi", "tim", "ve", "cho", "den"]
EN_CAPPED_WORDS = ["the", "and", "of", "to", "in", "is", "you", "me", "my", "love"]

# Genre-string patterns of the playlist vote.
VI_GENRE_PATTERNS = [
    "v-pop", "vietnamese", "vietnam indie", "vinahouse", "vietnamese lo-fi", "vietnamese hip hop", "vietnamese bolero",
]
WESTERN_GENRE_PATTERNS = [
    "soft pop", "pop", "hip hop", "rap", "rock", "country", "r&b", "electronic", "dance", "house", "edm", "dubstep",
]
CHINESE_GENRE_PATTERNS = ["c-pop", "mandopop", "chinese r&b", "cantopop"]
FIRST_MATCH_RULES = [
    (["v-pop", "vietnamese", "vietnam"], "vietnamese"), (["pop", "hip hop", "rap", "rock", "r&b"], "western"),
]

# Artists listed by the hint buckets.
HINT_ARTISTS = [
    "Sơn Tùng", "Hoàng Thùy Linh", "Đức Phúc", "Bích Phương", "Chi Pu", "Noo Phước Thịnh", "Hương Tràm", "Mỹ Tâm",
    "Đàm Vĩnh Hưng",
]

# Playlist names per category.
PLAYLIST_CATEGORIES = {
    "cultural": ["vpop", "us-uk"],
    "mood_positive": ["gleeful", "something_cute_and_dynamic", "sheer_love"],
    "mood_negative": ["heartbreaking", "such_a_bad_day"],
    "mood_chill": ["dreamy", "chillie", "tempalative_mood"],
    "activity": ["daily_music", "on_repeat", "repeat_rewind"],
    "memory": ["memory_brings_back", "lyrics_nail_ur_heart"],
    "energy": ["underground_battle"],
    "favorites": ["liked_songs", "best_songs"],
    "special": ["i_concert_lnh_chi"],
}
