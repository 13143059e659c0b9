"""Words by which products and categories are told. Fixed values; each line is a cluster and its substrings."""

from __future__ import annotations

TARGET_CATEGORIES = [
    "FOOD", "ORAL CARE", "АНТИСЕПТИКИ", "БАДЫ", "ВОЛОСЫ", "Вода подготовленная", "Вторичная тара", "ДЕТСТВО уход", "КУХНЯ (ручн)", "ЛИЦО", "МЫЛО",
    "НАБОРЫ baby", "НАБОРЫ beauty", "НАБОРЫ home", "НАБОРЫ home1", "НАБОРЫ home2", "НАБОРЫ oral", "ПММ", "Подгузники", "САНТЕХНИКА", "СТИРКА", "Салфетки",
    "ТЕЛО", "Товары для дома", "УБОРКА", "Флаконы-рефилл",
]

# In names of products.
PRODUCT_CLUSTERS = {
    "стирка": ["для стирк", "стирал", "стиральн", "прач", "ariel", "ариэль", "tide", "тайд", "losk", "лоск", "persil", "персил", "bingo стир"],
    "ополаскиватель_белья": ["ополаскив", "кондиционер для бель", "lenor", "ленор", "vernel", "вернель", "downy"],
    "пятновыводитель": ["пятновывод", "vanish", "ваниш", "антипятн"],
    "отбеливатель": ["отбелив", "белизн", "хлор жидк", "персоль"],
    "уход_за_одеждой": ["антистатик", "для одежд", "для обув"],
    "посуда_ручная": ["для мытья посуд", "мытья посуд", "посуд", "fairy", "фейри", "aos", "аос", "gala посуд", "palmolive посуд", "frosch посуд", "капля", "бальзам для посуд"],
    "посуда_пмм": ["для посудомоечн", "посудомоечн", "для посудомойк", "finish", "финиш", "таблетк для пм", "гель для пмм", "порошок для пмм"],
    "чистящее": ["чистящ", "cif", "сиф", "comet", "комет", "ajax", "аякс", "mr proper", "мистер пропер", "пемолюкс", "pemolux", "sanita"],
    "накипь": ["антинакип", "накипь", "antikalk", "calg", "кальг", "антикальц"],
    "ржавчина": ["от ржавчин", "ржавчин", "антиржав"],
    "стекло": ["для стекл", "стекл", "для зеркал"],
    "пол": ["для пол", "мытья пол", "паркет", "ламинат"],
    "мебель_ковры": ["для мебел", "ковр", "обивк"],
    "трубы": ["для труб", "прочист труб", "стоков"],
    "унитаз": ["для унитаз", "блок для унитаз", "унитаз", "domestos", "доместос", "duck", "дак", "bref", "бреф"],
    "сантехника": ["для сантехник", "сантехник", "для ванн", "ванн", "раковин", "дезинфицир", "дезинфект сантех"],
    "освежитель_воздуха": ["освежит воздух", "ароматиз воздух", "air freshener", "febreze", "фабриз", "glade", "глейд", "амбиантор", "аромадиффузор", "диффузор", "гелев освежит", "интерьерн освежит"],
    "насекомые": ["инсектицид", "репелент", "от насеком", "от мух", "от комар", "от моли", "от тараканов", "от муравьев", "ленты липкие"],
    "шампунь": ["шампун", "shampoo"],
    "кондиционер_волос": ["бальзам для волос", "кондиционер для волос", "ополаскиватель для волос", "маска для волос"],
    "средства_душ": ["гель для душ", "пена для душ", "пена для ванн", "соль для ванн", "скраб для тел", "соль для душ"],
    "мыло": ["мыло жидк", "мыло куск", "мыло хоз", "мыло туалетн", "мыло дет"],
    "зубы": ["зубн паст", "зубн щетк", "ополаскив для рт", "для полост рта", "нить зубн"],
    "дезодорант": ["дезодорант", "антиперспирант"],
    "депиляция": ["депиляц", "эпилятор", "воск для волос"],
    "бритье": ["для бритья", "пена для бритья", "гель для бритья", "после бритья", "бритв", "лезвия"],
    "уход_кожа": ["крем для кож", "лосьон для кож", "молочко для тел", "сыворотк", "маска для лиц", "скраб для лиц", "тоник"],
    "детская_гигиена": ["детск крем", "детск гель", "детск шампун", "детск мыло", "подгузник", "трусик подгузник", "присыпка детск", "детск лосьон", "детск масло"],
    "бумага": ["туалетн бумаг", "бумажн полотенц", "бумажн салфетк", "носов платок", "влажн салфетк"],
    "женская_гигиена": ["прокладк", "тампон", "ежедневн прокладк", "урологическ"],
    "загар": ["для загара", "автозагар", "после загара", "спф", "spf", "защит от солнц"],
    "универсальное": ["универсальн"],
}

# In names of target categories.
CATEGORY_CLUSTERS = {
    "стирка": ["стирк"],
    "ополаскиватель_белья": ["ополаскив", "кондиционер для бель"],
    "пятновыводитель": ["пятновывод", "пятн"],
    "отбеливатель": ["отбелив", "хлор"],
    "уход_за_одеждой": ["одежд", "обув"],
    "посуда_ручная": ["посуд", "кухн", "ручн"],
    "посуда_пмм": ["посудомоечн", "посудомойк", "пмм"],
    "чистящее": ["чистящ", "убор"],
    "накипь": ["накипь", "накип"],
    "ржавчина": ["ржавчин"],
    "стекло": ["стекл", "зеркал"],
    "пол": ["пол", "паркет"],
    "мебель_ковры": ["мебел", "ковр"],
    "трубы": ["труб", "стоков"],
    "унитаз": ["унитаз", "туалет"],
    "сантехника": ["сантехник", "ванн"],
    "освежитель_воздуха": ["освежит", "ароматиз", "воздух", "дом"],
    "насекомые": ["насеком", "инсектицид", "моль", "репелент", "дом"],
    "шампунь": ["шампун"],
    "кондиционер_волос": ["волос", "бальзам", "кондиционер"],
    "средства_душ": ["душ", "скраб", "тел"],
    "мыло": ["мыло"],
    "зубы": ["зуб", "полост рта", "oral"],
    "дезодорант": ["дезодорант", "антиперспирант", "тел"],
    "депиляция": ["депиляц", "тел"],
    "бритье": ["бритв", "тел"],
    "уход_лицо": ["лиц"],
    "уход_тело": ["тел"],
    "детская_гигиена": ["детск", "детств", "подгузник", "ребенк"],
    "бумага": ["бумаг", "салфетк", "платок"],
    "женская_гигиена": ["прокладк", "тампон", "гигиен", "тел"],
    "загар": ["загар", "солнц", "тел"],
    "универсальное": ["универсальн"],
    "антисептики": ["антисептик", "антибактер"],
}

# In source categories.
SOURCE_PHRASES = {
    "посуда_пмм": ["автоматического мытья", "посудомоечн"],
    "посуда_ручная": ["ручного мытья", "мытья посуд"],
    "стирка": ["для стирк", "стиральн"],
    "ополаскиватель_белья": ["ополаскив"],
    "пятновыводитель": ["пятновывод"],
    "отбеливатель": ["отбелив"],
    "уход_за_одеждой": ["ухода за одежд", "ухода за обув"],
    "чистящее": ["уборки", "чистящ"],
    "накипь": ["накип"],
    "ржавчина": ["ржавчин"],
    "стекло": ["для стекл"],
    "пол": ["для пол"],
    "мебель_ковры": ["для ковр"],
    "трубы": ["прочист труб"],
    "сантехника": ["для сантехник", "сантехник"],
    "унитаз": ["для унитаз", "блок унитаз"],
    "освежитель_воздуха": ["освежит", "ароматиз"],
    "насекомые": ["насеком", "инсектицид"],
    "кондиционер_волос": ["уход за волос", "волос"],
    "шампунь": ["шампун"],
    "зубы": ["полости рта", "зубами", "зубн"],
    "уход_лицо": ["кожи лица", "лица"],
    "уход_тело": ["кожи тела", "кожи рук", "тела"],
    "средства_душ": ["для душа"],
    "дезодорант": ["дезодорант", "антиперспирант"],
    "бритье": ["брить", "бритв"],
    "депиляция": ["депиляц"],
    "загар": ["загар"],
    "женская_гигиена": ["женск", "прокладк", "тампон"],
    "мыло": ["жидкого мыла", "личной гигиен", "мыл"],
    "антисептики": ["антисептик", "антибактер"],
    "детская_гигиена": ["подгузник", "детьм", "для детей", "детских", "детской"],
    "бумага": ["бумажн", "салфетк", "носов платк"],
}
