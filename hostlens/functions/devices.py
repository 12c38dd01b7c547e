"""What device codes, classes and names mean, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import gb, gib, parts, tenths

# Categories in order, with titles; health titles and marks; problem codes.
CATEGORIES = ("Processor", "Graphics", "Memory", "Storage", "Network", "Audio", "Motherboard", "Firmware", "Monitor", "UsbController", "Input", "System", "OtherDevice")
CATEGORY_TITLES = (
    "Процессор", "Видеокарта", "Оперативная память", "Накопители", "Сеть", "Звук", "Материнская плата", "BIOS / UEFI", "Мониторы",
    "USB-контроллеры", "Устройства ввода", "Системные устройства", "Прочие устройства",
)
HEALTH_TITLES = {"Ok": "Работает", "NeedsDriver": "Нет драйвера", "Disabled": "Отключено", "Error": "Ошибка", "NotConnected": "Не подключено", "Unknown": "Неизвестно"}
HEALTH_MARKS = {"Ok": "ok ", "NeedsDriver": "DRV", "Disabled": "off"}
DISABLED, NOT_CONNECTED, NEEDS_DRIVER = (22, 32, 44, 48), (24, 45), (1, 18, 28, 31, 37, 39, 52)
PNP_CLASSES = {
    "DISPLAY": 1, "NET": 4, "MEDIA": 5, "AUDIOENDPOINT": 5, "AUDIO": 5, "DISKDRIVE": 3, "SCSIADAPTER": 3, "HDC": 3, "USB": 9, "USBDEVICE": 9, "PROCESSOR": 0,
    "MONITOR": 8, "HIDCLASS": 10, "KEYBOARD": 10, "MOUSE": 10, "SYSTEM": 11,
}
MEMORY_TYPES = {20: "DDR", 21: "DDR2", 24: "DDR3", 26: "DDR4", 34: "DDR5"}
CONNECTION = {2: "Подключено", 0: "Отключено", 7: "Кабель не подключён"}
VENDOR_IDS = {"10DE": "NVIDIA", "1002": "AMD", "8086": "Intel"}
VENDOR_NAMES = (("NVIDIA", ("NVIDIA", "GEFORCE")), ("AMD", ("AMD", "RADEON", "ATI")), ("Intel", ("INTEL",)))
VENDOR_PAGES = {
    "NVIDIA": "https://www.nvidia.com/Download/index.aspx", "AMD": "https://www.amd.com/en/support", "Intel": "https://www.intel.com/content/www/us/en/download-center/home.html",
}
BASIC_ADAPTERS = ("BASIC DISPLAY", "STANDARD VGA", "БАЗОВ")
WORKS, UNKNOWN, NO_NAME, NONE = "Работает", "Неизвестно", "Неизвестное устройство", "—"
BASIC_TEXT = "Базовый видеодрайвер Windows — нужен драйвер видеокарты"
CODE_FALLBACK = "Код проблемы "
CODE_TEXTS = {
    0: "Работает нормально",
    1: "Устройство настроено неправильно",
    2: "Windows не может загрузить драйвер",
    3: "Драйвер повреждён или не хватает ресурсов",
    4: "Не работает: возможно повреждён драйвер или реестр",
    5: "Драйвер требует ресурс, которым Windows не управляет",
    6: "Конфликт конфигурации с другим устройством",
    7: "Не удаётся отфильтровать",
    8: "Не найден загрузчик драйвера",
    9: "Прошивка некорректно сообщает о ресурсах",
    10: "Устройство не может запуститься",
    11: "Сбой устройства",
    12: "Недостаточно свободных ресурсов (конфликт ресурсов)",
    13: "Windows не может проверить ресурсы устройства",
    14: "Требуется перезагрузка",
    15: "Проблема повторного перечисления",
    16: "Windows не может определить все ресурсы устройства",
    17: "Запрошен неизвестный тип ресурса",
    18: "Требуется переустановка драйверов",
    19: "Сбой реестра — переустановите драйвер",
    20: "Возможно повреждение системы (загрузчик VxD)",
    21: "Системный сбой; устройство удаляется",
    22: "Устройство отключено",
    23: "Системный сбой; смените драйвер",
    24: "Устройство отсутствует или не работает (нет драйверов)",
    25: "Windows ещё настраивает устройство",
    26: "Windows ещё настраивает устройство",
    27: "Нет действительной конфигурации",
    28: "Драйверы не установлены",
    29: "Отключено: прошивка не выдала нужные ресурсы",
    30: "Используется IRQ другого устройства",
    31: "Не удаётся загрузить нужные драйверы",
    32: "Драйвер/служба отключены",
    33: "Не удаётся определить нужные ресурсы",
    34: "Не удаётся определить настройки (нужна ручная настройка)",
    35: "Прошивке не хватает данных (обновите BIOS)",
    36: "Конфликт прерываний (смените настройку BIOS)",
    37: "Не удаётся инициализировать драйвер",
    38: "Предыдущий экземпляр драйвера ещё в памяти",
    39: "Не удаётся загрузить драйвер: повреждён или отсутствует",
    40: "Ошибка сведений о службе в реестре",
    41: "Драйвер загружен, но оборудование не найдено",
    42: "Дубликат уже работающего устройства",
    43: "Windows остановила устройство из-за неполадок",
    44: "Устройство остановлено приложением/службой",
    45: "Устройство сейчас не подключено",
    46: "Нет доступа: система завершает работу",
    47: "Подготовлено к извлечению, но не извлечено",
    48: "Запуск ПО заблокирован из-за известных проблем",
    49: "Системный куст реестра слишком велик",
    50: "Не удаётся применить все свойства устройства",
    51: "Ожидает запуска другого устройства",
    52: "Не удаётся проверить цифровую подпись драйвера",
    53: "Зарезервировано для отладчика ядра",
    54: "Сбой; выполняется сброс",
}


def mapped(column: Column, table: dict, default: Column) -> Column:
    """A constant map's value, or the default. Catalyst folds the map into the plan."""
    entries = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(entries, column), default)


def classify(code: Column) -> Column:
    """The health of a problem code."""
    return F.when(code == 0, "Ok").when(code.isin(*DISABLED), "Disabled").when(code.isin(*NOT_CONNECTED), "NotConnected").when(code.isin(*NEEDS_DRIVER), "NeedsDriver").otherwise("Error")


def describe(code: Column) -> Column:
    return mapped(code, CODE_TEXTS, F.concat(F.lit(CODE_FALLBACK), code.cast("string")))


def device_health(code: Column) -> Column:
    """Of a device of a typed scan: codes up to 0 count as working."""
    return F.when(code > 0, classify(code)).otherwise("Ok")


def device_health_text(code: Column) -> Column:
    return F.when(code > 0, describe(code)).otherwise(WORKS)


def needs_attention(health: Column) -> Column:
    return health.isin("NeedsDriver", "Error", "Disabled")


def on_driver_page(health: Column) -> Column:
    return health.isin("NeedsDriver", "Error")


def health_title(health: Column) -> Column:
    return mapped(health, HEALTH_TITLES, F.lit(UNKNOWN))


def health_mark(health: Column) -> Column:
    return mapped(health, HEALTH_MARKS, F.lit("ERR"))


def category_title(category: Column) -> Column:
    return mapped(category, dict(enumerate(CATEGORY_TITLES)), F.lit(CATEGORY_TITLES[-1]))


def pnp_category(pnp_class: Column) -> Column:
    return mapped(F.upper(pnp_class), PNP_CLASSES, F.lit(12))


def gpu_vendor(pnp_device_id: Column, maker: Column, name: Column, strict_vendor: bool = False) -> Column:
    """The vendor id in the device id decides, else words of maker and name, else `Unknown`.

    The word ATI also stands in "Corporation", so makers of that name without a known id are AMD. Extension: strict_vendor takes it as a whole word only.
    """
    upper = F.upper(pnp_device_id)
    at = F.locate("VEN_", upper)
    vendor_id = F.when((at > 0) & (F.length(upper) >= at + 7), F.substring(upper, at + 4, F.lit(4))).otherwise("")
    words = F.upper(F.concat_ws(" ", maker, name))
    has = lambda w: words.rlike(r"\bATI\b") if strict_vendor and w == "ATI" else words.contains(w)
    out = F.lit("Unknown")
    for vendor, names in reversed(VENDOR_NAMES):
        found = has(names[0])
        for n in names[1:]:
            found = found | has(n)
        out = F.when(found, vendor).otherwise(out)
    return mapped(vendor_id, VENDOR_IDS, out)


def vendor_name(vendor: Column) -> Column:
    return F.when(vendor == "Unknown", UNKNOWN).otherwise(vendor)


def vendor_page(vendor: Column) -> Column:
    """The vendor's driver page; null for an unknown one."""
    return mapped(vendor, VENDOR_PAGES, F.lit(None).cast("string"))


def basic_adapter(name: Column) -> Column:
    upper = F.upper(name)
    found = upper.contains(BASIC_ADAPTERS[0])
    for x in BASIC_ADAPTERS[1:]:
        found = found | upper.contains(x)
    return found


def memory_name(capacity: Column, smbios_type: Column, configured_clock: Column, speed: Column) -> Column:
    """Size, type and clock: the configured clock, or the rated one where it is not set."""
    clock = F.when(configured_clock > 0, configured_clock).otherwise(speed)
    size = F.concat(tenths(gib(capacity)), F.lit(" ГБ "), mapped(smbios_type, MEMORY_TYPES, F.lit("RAM")))
    return F.concat(size, F.when(clock > 0, F.concat(F.lit(" · "), clock.cast("string"), F.lit(" МГц"))).otherwise(""))


def connection(code: Column) -> Column:
    return mapped(code, CONNECTION, F.lit(""))


def disk_media(media_type: Column, bus_type: Column) -> Column:
    """SSD or HDD, with NVMe by the bus; empty if neither is known."""
    kind = F.when(media_type == 4, "SSD").when(media_type == 3, "HDD").otherwise("")
    return F.when(bus_type == 17, parts(" ", kind, F.lit("NVMe"))).otherwise(kind)


def disk_size(size_bytes: Column) -> Column:
    return F.concat(F.format_string("%.0f", gb(size_bytes)), F.lit(" ГБ"))


def cpu_detail(cores: Column, threads: Column, mhz: Column) -> Column:
    """Cores, threads and GHz with one decimal, in whole tenths."""
    n = F.floor((mhz + 50) / 100).cast("int")
    clock = F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    return F.concat(cores.cast("string"), F.lit(" ядер / "), threads.cast("string"), F.lit(" потоков · "), clock, F.lit(" ГГц"))


def resolution(hres: Column, vres: Column) -> Column:
    return F.when((hres > 0) & (vres > 0), F.concat(hres.cast("string"), F.lit("×"), vres.cast("string"))).otherwise("")


def driver_summary(version: Column, date: Column, provider: Column) -> Column:
    """Version, date and provider; a dash if neither version nor date is known."""
    v = F.when(version == "", "").otherwise(F.concat(F.lit("v"), version))
    return F.when((version == "") & (date == ""), NONE).otherwise(parts("  ·  ", v, date, provider))
