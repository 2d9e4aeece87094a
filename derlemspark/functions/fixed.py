"""Rule tables of the engine. All are parameters of the operators; these are their default values."""

# Closed sets of the document contract.
CATEGORIES = ("genel_bilgi", "kampus", "egitim", "bolumler", "lisansustu", "ogrenci_isleri", "erasmus", "topluluklar", "spor", "ulasim", "yemekhane", "kutuphane", "etkinlikler", "akademik_kadro", "dijital_hizmetler", "duyurular", "aday_ogrenci", "mezunlar", "yonlendirme", "kariyer", "iletisim")
DOC_KINDS = ("yonetmelik", "yonerge", "duyuru", "haber", "tanitim", "rehber", "iletisim", "form", "mufradat", "ders_plani", "yonetim", "rapor", "menu_haritasi", "takvim", "personel", "pdf_rapor", "genel", "sss", "program_listesi", "birim_iletisim", "birim_iletisim_tablosu")
SOURCE_TYPES = ("pdf", "web", "manual")
REQUIRED_FIELDS = ("category", "source_url", "source_type", "source_id", "title", "doc_kind", "department")
RECOMMENDED_FIELDS = ("last_updated", "contact_unit", "contact_info", "language")
MIN_CONTENT, MAX_CONTENT = 50, 100_000
SHORT_KINDS = ("iletisim", "form")

# Placeholder patterns of the ingest check and keywords of the quality check, in their order.
PLACEHOLDER_PATTERNS = (r"lorem\s+ipsum", r"under\s+construction", r"yakında\s+eklenecek", r"içerik\s+hazırlanıyor", r"bu\s+sayfa\s+yapım\s+aşamasında", r"content\s+coming\s+soon")
PLACEHOLDER_KEYWORDS = ("lorem ipsum", "örnek metin", "içerik eklenecek", "yapım aşamasında", "coming soon", "under construction", "bu sayfa henüz", "test sayfası", "yakında eklenecek", "içerik hazırlanıyor")

# Url pattern -> document kind, the first that matches counts.
URL_KINDS = (
    (r"birimyonetim\.aspx", "yonetim"), (r"birimmisyon\.aspx", "tanitim"), (r"birimvizyon\.aspx", "tanitim"), (r"birimtarihce\.aspx", "tanitim"), (r"birimhakkimizda\.aspx", "tanitim"),
    (r"birimtanitim\.aspx", "tanitim"), (r"birimgorevtanimi\.aspx", "tanitim"), (r"birimform\.aspx", "form"), (r"birimmevzuat\.aspx", "yonetmelik"), (r"birimiletisim\.aspx", "iletisim"),
    (r"birimtelefonrehberi\.aspx", "iletisim"), (r"birimduyuru\.aspx", "duyuru"), (r"birimhaber\.aspx", "haber"), (r"birimduyuruarsivi\.aspx", "duyuru"), (r"birimrapor\.aspx", "rapor"),
    (r"birimgaleri\.aspx", "genel"), (r"birimfaydalilink\.aspx", "genel"), (r"birimsss\.aspx", "genel"), (r"birimakademikpersonel\.aspx", "personel"), (r"birimidaripersonel\.aspx", "personel"),
    (r"/kalite[/-]", "rapor"), (r"/mufradat", "mufradat"), (r"/ders-program", "mufradat"), (r"/ders-icerik", "mufradat"), (r"/bologna", "mufradat"), (r"/duyuru", "duyuru"), (r"/haber", "haber"),
    (r"/etkinlik", "haber"), (r"/konferans", "haber"), (r"/seminer", "haber"), (r"/misyon", "tanitim"), (r"/vizyon", "tanitim"), (r"/tarihce", "tanitim"), (r"/organizasyon", "tanitim"),
    (r"/faaliyet-rapor", "rapor"), (r"/ic-ve-dis-payda", "rapor"), (r"/prosedur", "yonetmelik"), (r"/talimat", "yonetmelik"), (r"/yonerge", "yonetmelik"),
)
# File name pattern -> document kind, in order (case-folded text).
FILE_KINDS = (
    ("yönetmeli[kğ]", "yonetmelik"), ("yönerge", "yonerge"), ("müfredat|mufredat|ders *içerik|öğretim *plan", "ders_plani"), ("tanıtım|tanitim", "tanitim"), ("^detay +", "tanitim"),
    ("iş *akış|is *akis|kılavuz|kilavuz|el *kitab", "rehber"), ("usul +ve +esas|uygulama +esas|uygulama +ilke", "rehber"), ("kanun", "yonetmelik"), ("form|başvuru +dosya", "form"),
)
# File name keywords -> category, in order.
FILE_CATEGORIES = (
    ("erasmus|ka131|ka171", "erasmus"), ("dış ilişkiler|dis iliskiler", "erasmus"), ("uluslararası öğrenci", "erasmus"), ("lisansüstü|enstitü", "lisansustu"), ("tez |tez\t|seminer", "lisansustu"),
    ("akademik yükseltme|puan tablosu", "akademik_kadro"), ("hizmet içi", "genel_bilgi"), ("uzaktan.*(öğretim|eğitim)|(öğretim|eğitim).*uzaktan", "egitim"), ("akademik takvim", "egitim"), ("ders kayıt|ders kayit", "egitim"), ("staj", "egitim"),
    ("yatay geçiş|yatay gecis", "ogrenci_isleri"), ("askerlik", "ogrenci_isleri"), ("yükseköğretim kanunu", "genel_bilgi"), ("sınav", "egitim"), ("diploma", "ogrenci_isleri"), ("öğrenci.*kural|kural.*öğrenci", "egitim"),
)
# Folder kinds that no file name overrides.
FOLDER_KINDS = ("yonetmelik", "yonerge")
# File name keywords -> department, in order.
FILE_DEPARTMENTS = (
    ("bilgisayar mühendisliği|^bmb", "Bilgisayar Mühendisliği"), ("elektrik|elektronik|^eem", "Elektrik-Elektronik Mühendisliği"), ("endüstri mühendisliği", "Endüstri Mühendisliği"), (r"tıp|(^|\s)tip(\s|$)", "Tıp Fakültesi"),
    ("hemşire|hemsire", "Hemşirelik"), (r"(^|\s)ebe(\s|$)", "Ebelik"), ("fizyoterapi", "Fizyoterapi"), ("arapça|arapca", "Arapça Mütercim ve Tercümanlık"), ("ingilizce.*mütercim|mütercim.*ingilizce", "İngilizce Mütercim ve Tercümanlık"),
    ("islami ilimler", "İslami İlimler"), ("radyo", "Radyo ve Televizyon Teknolojisi"), ("makine", "Makine ve Metal Teknolojileri"), ("laboratuvar", "Tıbbi Laboratuvar Teknikleri"), ("acil yardım|ilk ve acil", "İlk ve Acil Yardım"),
    ("ameliyathane", "Ameliyathane Hizmetleri"), ("yaşlı bakım|yasli bakim", "Yaşlı Bakım"), ("bilgisayar programcılığı|bilgisayarprogramciligi", "Bilgisayar Programcılığı"), ("yabancı diller yüksekokulu", "Yabancı Diller Yüksekokulu"), ("kariyer", "Kariyer Geliştirme Merkezi"),
)
# File name keywords, or else the category -> contact unit, in order.
FILE_CONTACTS = (
    ("erasmus", "erasmus", "Dış İlişkiler Koordinatörlüğü / Erasmus+ Ofisi"), ("lisansüstü|enstitü", "lisansustu", "Lisansüstü Eğitim Enstitüsü"), ("", "ogrenci_isleri", "Öğrenci İşleri Daire Başkanlığı"),
    ("staj", "", "İlgili Bölüm Staj Komisyonu"), ("diploma", "", "Öğrenci İşleri Daire Başkanlığı"), ("faaliyet raporu|stratejik plan|değerlendirme raporu|degerlendirme raporu", "", "Strateji Geliştirme Daire Başkanlığı"),
)

# Words left out of the keyword leg.
STOPWORDS = (
    "hangi", "ne", "neler", "nedir", "nasıl", "nerede", "nereye", "nereden", "kim", "kime", "kimin", "neden", "niçin", "niye", "kaç", "kadar", "mi", "mı", "mu", "mü", "var", "yok", "olan", "olarak", "olmak", "olur", "olabilir",
    "almak", "istiyorum", "istiyoruz", "ister", "istiyor", "diyor", "eder", "yapar", "verir", "gelir", "gider", "son", "ilk", "en", "bir", "birçok", "ve", "veya", "ile", "için", "gibi", "ama", "fakat", "de", "da", "den", "dan", "bu", "şu", "o",
)
# Abbreviations of units and systems.
ABBREVIATIONS = {
    "mdbf": "mühendislik ve doğa bilimleri fakültesi", "sbf": "sağlık bilimleri fakültesi", "shmyo": "sağlık hizmetleri meslek yüksekokulu", "tbmyo": "teknik bilimler meslek yüksekokulu",
    "iisbf": "iktisadi idari ve sosyal bilimler fakültesi", "iii": "iktisadi idari ve sosyal bilimler fakültesi", "gsmf": "güzel sanatlar tasarım ve mimarlık fakültesi", "ydyo": "yabancı diller yüksekokulu",
    "sks": "sağlık kültür ve spor daire başkanlığı", "obs": "öğrenci bilgi sistemi", "ubys": "üniversite bilgi yönetim sistemi", "lms": "öğrenme yönetim sistemi", "kyk": "kredi ve yurtlar kurumu", "yök": "yükseköğretim kurulu",
    "tömer": "türkçe öğretimi merkezi", "bap": "bilimsel araştırma projeleri",
}
# Words spelling correction aims at.
DOMAIN_TERMS = (
    "bilgisayar", "mühendislik", "mühendisliği", "endüstri", "elektrik", "elektronik", "hemşirelik", "ebelik", "fizyoterapi", "rehabilitasyon", "gastronomi", "ilahiyat", "mimarlık", "tasarım", "mütercim", "tercümanlık", "ameliyathane",
    "laboratuvar", "radyo", "televizyon", "makine", "bilgisayarcılık", "programcılık", "üniversite", "fakülte", "yüksekokul", "enstitü", "bölüm", "kütüphane", "yemekhane", "müfredat", "transkript", "erasmus", "akreditasyon", "devamsızlık",
    "yönetmelik", "koordinatörlük", "dekanlık", "rektörlük", "kontenjan", "başvuru", "kayıt", "mezuniyet", "kampüs", "yurt", "spor",
)
# Beginnings of words in a question and the units they lead to, the first that matches counts.
TOPICS = (
    (r"transkript|not\s+belgesi|öğrenci\s+belgesi|ilişik\s+kes|kayıt\s+dondur|kayıt\s+sil|harç|katkı\s+payı", "öğrenci işleri daire başkanlığı"), ("burs|kyk|yurt|barınma", "sağlık kültür ve spor daire başkanlığı"),
    (r"erasmus|mevlana|farabi|değişim\s+program", "uluslararası ilişkiler koordinatörlüğü"), (r"staj|zorunlu\s+staj|staj\s+defteri", "bölüm başkanlığı staj koordinatörlüğü"),
)
# Questions out of scope, as beginnings of words, those that must follow, and those that must not follow; and words that keep a question in scope.
OUT_OF_SCOPE = (
    (r"python|javascript|java|c\+\+|html|css|sql|php|ruby|swift|kotlin|rust|go|typescript", "kod|code|yaz|script|program|fonksiyon|function|class|sınıf", ""),
    ("kod|code|script|program|fonksiyon|function", "yaz|oluştur|üret|generate|create", ""),
    ("başkent|başbakan|cumhurbaşkan|nüfus|yüzölçüm", r"nere|ne\s?dir|kim|kaç", ""),
    (r"nere|ne\s?dir|kim", "başkent|başbakan|cumhurbaşkan|nüfus", ""),
    (r"hava\s+durumu|döviz|borsa|kripto|bitcoin|maç\s+skor|lig\s+puan", "", ""),
    (r"yemek\s+tarif|diyet\s+liste|kalori\s+hesapla", "", ""),
    (r"şiir\s+yaz|hikaye\s+yaz|roman\s+yaz|mektup\s+yaz|söz\s+yaz", "", ""),
    (r"çevir|translate|tercüme\s+et", "ingilizce|almanca|fransızca|arapça|japonca", ""),
    (r"hesapla|kaç\s+eder|karekök|integral|türev|faktöriyel", "", "harç|ücret|kredi|ders|akts"),
)
SIGNALS = (
    "üniversite", "universite", "fakülte", "fakulte", "bölüm", "bolum", "enstitü", "myo", "yüksekokul", "rektör", "dekan", "dekanlık", "ders", "sınav", "sinav", "transkript", "diploma", "mezuniyet", "kayıt", "devamsızlık", "müfredat", "akts", "kredi",
    "kontenjan", "başarı", "not", "dönem", "erasmus", "staj", "burs", "yurt", "yemekhane", "kütüphane", "kulüp", "topluluk", "öğrenci", "obs", "ubys", "lms", "harç", "duyuru", "yönetmelik", "yönerge", "mdbf", "sbf", "shmyo", "tbmyo", "ydyo", "gsmf", "sks", "ilahiyat", "tıp",
)
# Suffixes stripped by the simple stemmer, in order.
SUFFIXES = ("ları", "leri", "ler", "lar", "ını", "ini", "unu", "ünü", "nın", "nin", "nun", "nün", "dan", "den", "tan", "ten", "ya", "ye", "na", "ne", "da", "de", "ta", "te", "ı", "i", "u", "ü")
# Signs of grounding and redaction.
URL = r"https?://[^\s\)\]\}>\"']+"
PHONE = r"\+?\(?\d[\d\s\(\)\-]{8,}\d"
EMAIL = r"[\w.+-]+@[\w.-]+\.\w{2,}"
LOCAL_PATH = r"[A-Za-z]:\\[^\s\"]+"
PII = ((r"\b\d{11}\b", "[TC_KİMLİK_FİLTRELENDİ]"), (r"\b\d{8,10}\b", "[ÖĞRENCİ_NO_FİLTRELENDİ]"), (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[E_POSTA_FİLTRELENDİ]"))
ACADEMIC_CONTEXT = ("akademik", "eğitim öğretim", "öğretim yılı", "güz", "bahar", "dönem", "müfredat", "ders")
REPORT_KINDS = ("rapor", "pdf_rapor")
REPORT_WORDS = ("rapor", "faaliyet", "değerlendirme", "degerlendirme")
