"""Word lists. Results depend on each entry and, where noted, on the order."""

# ruff: noqa: E501

#: Portuguese function words and shop boilerplate.
STOPWORDS = [
    "o", "a", "os", "as", "um", "uma", "uns", "umas", "de", "da", "do", "das", "dos", "em", "na", "no", "nas", "nos", "por", "para", "com",
    "sem", "sob", "sobre", "até", "ate", "após", "apos", "ante", "entre", "contra", "desde", "durante", "perante", "mediante", "conforme",
    "segundo", "exceto", "salvo", "fora", "além", "alem", "e", "ou", "mas", "porém", "porem", "todavia", "contudo", "entretanto", "que",
    "se", "porque", "como", "quando", "enquanto", "embora", "pois", "logo", "portanto", "então", "entao", "eu", "tu", "ele", "ela", "nós",
    "vós", "vos", "eles", "elas", "me", "te", "lhe", "lhes", "meu", "minha", "seu", "sua", "seus", "suas", "nosso", "nossa", "nossos",
    "nossas", "este", "esta", "estes", "estas", "esse", "essa", "esses", "essas", "aquele", "aquela", "aqueles", "aquelas", "isto", "isso",
    "aquilo", "tudo", "nada", "algo", "alguém", "alguem", "ninguém", "ninguem", "é", "são", "sao", "foi", "foram", "ser", "estar", "ter",
    "há", "ha", "tem", "têm", "tinha", "tinham", "pode", "podem", "deve", "devem", "vai", "vão", "vao", "não", "nao", "sim", "já", "ja",
    "ainda", "sempre", "nunca", "talvez", "também", "tambem", "mais", "menos", "muito", "pouco", "bem", "mal", "aqui", "ali", "lá", "la",
    "agora", "antes", "depois", "apenas", "somente", "só", "so", "mesmo", "assim", "dois", "três", "tres", "quatro", "cinco", "seis",
    "sete", "oito", "nove", "dez", "ver", "comprar", "adicionar", "carrinho", "frete", "grátis", "gratis", "clique", "acesse", "confira",
    "disponível", "disponivel", "estoque", "parcelas", "parcelado", "avaliações", "avaliacoes", "voltar", "início", "inicio", "cadastro",
    "login", "conta", "departamento", "busca", "pesquisa", "resultado", "página", "pagina", "anterior", "próximo", "proximo",
]

#: Inflection endings, tried in this order.
SUFFIXES = [
    "amentos", "imentos", "adores", "adoras", "ações", "acoes", "ências", "encias", "âncias", "ancias", "amento", "imento", "ação", "acao",
    "ência", "encia", "ância", "ancia", "mente", "istas", "agens", "agem", "ando", "endo", "indo", "ável", "avel", "ível", "ivel", "dades",
    "dade", "ista", "ores", "oras", "ões", "oes", "ção", "cao", "ais", "eis", "uis", "mos", "des", "res", "ves", "les", "ada", "ado",
    "ida", "ido", "ara", "ará", "era", "erá", "ira", "irá", "ava", "ia", "ar", "er", "ir", "ou", "eu", "as", "os", "es", "is", "us", "a",
    "o", "e",
]

#: A product whose name has one of these is hardware, unless it has one of NON_HARDWARE.
HARDWARE = [
    "placa de vídeo", "placa de video", "placa gráfica", "gpu", "rtx", "gtx", "radeon", "geforce", "vga", "nvidia", "amd rx",
    "processador", "cpu", "ryzen", "intel core", "core i3", "core i5", "core i7", "core i9", "threadripper", "xeon", "memória ram",
    "memoria ram", "ram ddr", "ddr4", "ddr5", "dimm", "ssd", "hd interno", "hd externo", "nvme", "m.2", "disco rígido", "disco rigido",
    "hdd", "sata iii", "seagate", "western digital", "pen drive", "pendrive", "cartão de memória", "cartao de memoria", "placa-mãe",
    "placa mãe", "placa-mae", "placa mae", "motherboard", "mainboard", "socket am", "lga 1", "fonte de alimentação", "fonte atx", "psu",
    "w bronze", "w gold", "gabinete gamer", "gabinete pc", "case pc", "torre gamer", "cooler para", "water cooler", "air cooler",
    "cooler master", "fan rgb", "ventoinha", "refrigeração", "coolers fan", "deepcool", "teclado mecânico", "teclado mecanico",
    "teclado gamer", "keyboard", "mouse gamer", "mouse sem fio", "mousepad", "mouse pad", "monitor gamer", "monitor 144hz",
    "monitor 240hz", "monitor curvo", "headset gamer", "headset 7.1", "fone de ouvido gamer", "cadeira gamer", "cadeira-gamer",
    "mesa gamer", "pc gamer", "notebook gamer", "desktop gamer", "computador gamer", "workstation", "notebook", "laptop", "ideapad",
    "thinkpad", "vivobook", "zenbook", "macbook", "chromebook", "monitor ", "monitor-", "headset ", "headset-", "fone gamer", "fone-gamer",
    "playstation", "xbox", "nintendo", "ps5", "ps4", "switch", "console", "controle gamer", "smart tv", "smart-tv", "tv 4k", "tv-4k",
    "oled", "qled", "tv led", "tv-led", "roteador", "router", "switch de rede", "placa de rede", "wifi 6", "webcam", "nobreak", "ups",
    "estabilizador", "hub usb", "leitor", "intelbras", "câmera de segurança", "camera de seguranca",
]

#: These win over HARDWARE.
NON_HARDWARE = [
    "carro", "veículo", "veiculo", "automóvel", "automovel", "moto", "motocicleta", "caminhão", "caminhao", "combustível", "gasolina",
    "diesel", "pneu", "automotivo", "roupa", "camiseta", "calça", "sapato", "tênis", "tenis", "vestido", "blusa", "jaqueta", "moda",
    "móveis", "moveis", "sofá", "sofa", "cama", "colchão", "colchao", "mesa de jantar", "cadeira de jantar", "guarda-roupa", "geladeira",
    "fogão", "fogao", "microondas", "lavadora", "máquina de lavar", "maquina de lavar", "ar condicionado", "ventilador de teto",
    "liquidificador", "batedeira", "iphone", "samsung galaxy", "smartphone", "celular", "capa de celular", "película", "pelicula",
    "capinha", "brinquedo", "boneca", "boneco", "lego", "carrinho", "perfume", "maquiagem", "cosmético", "cosmetico", "shampoo",
    "hidratante", "protetor solar", "comida", "alimento", "bebida", "ração", "racao", "pet", "cachorro", "gato", "casinha", "comedouro",
    "pote", "tigela", "bowl", "panela", "frigideira", "assadeira", "fritadeira", "air fryer", "airfryer", "forno", "cafeteira",
    "purificador", "filtro de água", "filtro de agua", "aspirador", "cooktop", "lava louça", "lava louca", "lava-louça",
    "multiprocessador", "processador de alimentos", "mixer", "livro", "kindle", "bicicleta", "patinete", "skate", "instrumento musical",
    "violão", "violao", "guitarra", "bolsa térmica", "bolsa termica", "garrafa térmica", "tapete higiênico", "tapete higienico",
    "hipótese", "hipotese", "principe", "arado", "torto", "creatina", "oximetro",
]

#: The product report's own lists, in which hardware wins.
REPORT_HARDWARE = [
    "placa de vídeo", "placa de video", "gpu", "rtx", "gtx", "radeon", "geforce", "vga", "processador", "cpu", "ryzen", "intel", "core i",
    "amd", "memoria", "memória", "ram", "ddr4", "ddr5", "ssd", "hd", "nvme", "disco", "armazenamento", "m.2", "placa-mãe", "placa mãe",
    "motherboard", "placa mae", "fonte", "psu", "w bronze", "w gold", "watt", "gabinete", "case", "torre", "cooler", "water cooler",
    "air cooler", "ventilador", "teclado", "keyboard", "mecânico", "mecanico", "mouse", "mousepad", "monitor", "polegadas", '"', "hz",
    "headset", "fone", "microfone", "notebook", "laptop", "pc gamer", "roteador", "wifi", "rede",
]

#: The product report's words against hardware.
REPORT_NON_HARDWARE = [
    "carro", "veículo", "veiculo", "automóvel", "automovel", "moto", "motocicleta", "caminhão", "caminhao", "roupa", "camiseta", "calça",
    "sapato", "tênis", "tenis", "móveis", "moveis", "sofá", "sofa", "cama", "colchão", "geladeira", "fogão", "fogao", "microondas",
    "lavadora", "celular", "iphone", "samsung galaxy", "smartphone", "brinquedo", "boneca", "lego", "perfume", "maquiagem", "cosmético",
    "livro", "kindle", "comida", "alimento", "bebida",
]

#: Words of each category; of equal scores the earlier category wins.
CATEGORIES = {
    "gpu": ["placa de video", "placa de vídeo", "geforce", "radeon", "rtx", "gtx", "rx 5", "rx 6", "rx 7"],
    "cpu": ["processador", "ryzen", "intel core", "i3", "i5", "i7", "i9", "amd ryzen"],
    "ram": ["memoria ram", "memória ram", "ddr4", "ddr5", "dimm"],
    "ssd": ["ssd", "nvme", "m.2", "disco sólido"],
    "hdd": ["hd sata", "hd interno", "hd externo", "disco hd", "hdd", "disco rígido", "hard disk", "hard drive"],
    "motherboard": ["placa mae", "placa mãe", "motherboard", "placa-mãe"],
    "psu": ["fonte", "power supply", "psu", "fonte de alimentação"],
    "cooler": ["cooler", "water cooler", "air cooler", "ventilador"],
    "case": ["gabinete", "case", "torre"],
    "monitor": ["monitor", "tela", "display"],
    "keyboard": ["teclado", "keyboard", "mecânico"],
    "mouse": ["mouse", "rato", "gamer mouse"],
    "headset": ["headset", "fone", "headphone", "auricular"],
}
