"""The canonical sales schema: fields, what anonymising does with them, output order, and the header names each goes by."""

from __future__ import annotations

# Canonical fields with their action under anonymisation.
FIELDS = {
    "week": "keep",
    "month": "keep",
    "year": "keep",
    "store_code": "drop",
    "store_name": "anon_store",
    "address": "anon_store",
    "distribution_center": "anon_company",
    "region": "keep",
    "store_format": "keep",
    "store_subformat": "keep",
    "category_0": "keep",
    "category_1": "keep",
    "category_2": "keep",
    "category_3": "keep",
    "category_4": "keep",
    "item_code": "drop",
    "item_name": "anon_product",
    "brand": "anon_brand",
    "manufacturer": "anon_company",
    "supplier": "anon_company",
    "weight": "keep",
    "unit": "keep",
    "barcode": "drop",
    "qty_sold": "add_qty",
    "sales_rub": "mul_price",
    "cost_rub": "mul_price",
}
# The measures.
METRICS = ("qty_sold", "sales_rub", "cost_rub")

# Order of the output columns.
OUTPUT_ORDER = [
    "week", "month", "year", "store_name", "address", "region", "store_format", "store_subformat", "distribution_center", "category_0", "category_1", "category_2",
    "category_3", "category_4", "target_category", "category_confidence", "canonical_name", "item_name", "brand", "manufacturer", "supplier", "weight", "unit",
    "qty_sold", "sales_rub", "cost_rub",
]

# Header names of each field, as extracts write them.
ALIASES = {
    "week": ["неделя", "нед", "week", "wk", "неделя продаж"],
    "month": ["месяц", "мес", "month", "mo"],
    "year": ["год", "year", "yr", "год продаж"],
    "store_code": ["код", "код магазина", "код тт", "store_code", "id магазина", "код торговой точки"],
    "store_name": ["название магазина", "магазин", "маг", "наим магазина", "тт", "store", "store_name", "торговая точка"],
    "address": ["адрес", "address", "addr", "адрес магазина"],
    "distribution_center": [
        "основной рц", "рц", "distribution center", "distribution_center", "распределительный центр", "основной распределительный центр",
        "склад", "dc",
    ],
    "region": ["регион", "region", "reg", "рег", "регион продаж", "территория", "регион тт", "область"],
    "store_format": ["формат", "format", "тип магазина", "формат магазина", "формат тт"],
    "store_subformat": ["субформат", "subformat", "sub-format", "подформат", "суб-формат", "тип тт"],
    **{f"category_{k}": [f"уровень {k}", f"уровень{k}", f"level {k}", f"category_{k}", f"cat{k}", f"lvl{k}", f"категория {k}"] for k in range(5)},
    "item_code": [
        "код позиции", "код товара", "sku", "item_code", "артикул", "арт", "код поз", "article", "product_id", "product_code", "код продукта",
    ],
    "item_name": [
        "наименование", "название товара", "товар", "позиция", "item_name", "item", "наим", "назв", "name", "full_name", "short_name",
        "номенклатура", "наименование номенклатуры", "товарная позиция", "product_name", "goods_name", "sku_name", "наименование товара",
        "название продукта", "наименование продукта", "наим товара", "наим продукта", "наименование позиции",
    ],
    "brand": ["бренд", "brand", "марка", "торговая марка", "brandname"],
    "manufacturer": ["производитель", "произв", "пр-ль", "manufacturer", "mfr", "producer", "изготовитель"],
    "supplier": ["поставщик", "supplier", "spl", "поставщ", "дистрибьютор"],
    "weight": ["вес", "weight", "масса", "вес нетто", "net weight", "вес брутто", "масса нетто"],
    "unit": ["единица измерения", "ед. изм.", "ед.изм.", "unit", "units", "ед изм", "единица", "ед"],
    "barcode": ["штриховой код", "штрихкод", "ean", "barcode", "bar code", "код штрих", "баркод"],
    "qty_sold": [
        "продажи в шт", "продажи в шт.", "qty", "qty_sold", "шт", "количество", "кол-во", "продажи в штуках", "quantity", "qty_pcs",
        "sold_qty", "продано", "продажи шт", "кол-во проданных", "продажи в натур", "реализация шт", "отгрузка шт",
    ],
    "sales_rub": [
        "продажи в руб", "продажи в руб.", "sales_rub", "выручка", "оборот", "продажи в рублях", "sales", "revenue", "выручка от продаж",
        "реализация", "выручка от реализации", "оборот в руб", "сумма продаж", "реализация руб",
    ],
    "cost_rub": [
        "себестоимость", "себестоимсть", "себестоимость в руб", "себестоимсть в руб", "cost_rub", "cost", "себес", "закупка", "закупочная цена",
    ],
}
ALIASES["category_4"] += ["subject", "предмет", "категория", "category", "group", "группа", "подкатегория"]
#: Further names seen in extracts.
MORE_ALIASES = {
    "store_name": ["название точки"],
    "region": ["регион сбыта"],
    **{f"category_{k}": [f"категория ур {k}", f"ур {k}"] for k in range(5)},
}
# Endings about VAT, which do not belong to a name.
VAT_ENDINGS = (" с ндс", " без ндс", ". с ндс", " с nds", " incl. vat", " excl. vat")
