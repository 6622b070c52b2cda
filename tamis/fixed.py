"""Word lists, patterns, labels and limits that results depend on."""

from __future__ import annotations

# ---- fixed values: symptoms -------------------------------------------------------------------------------
UX, AUDIO, QUEUE = "FALHA_INTERFACE_UX", "FALHA_CHAMADA_AUDIO", "FALHA_FILA_ROTEAMENTO"
UNKNOWN, TOO_SHORT = "SINTOMA_DESCONHECIDO", "TEXTO_MUITO_CURTO"
SYMPTOM_LABELS = {
    UX: "Falha de interface / experiência do usuário",
    AUDIO: "Falha de áudio em chamada",
    QUEUE: "Falha de fila / roteamento",
    UNKNOWN: "Sintoma não reconhecido",
    TOO_SHORT: "Texto insuficiente para análise",
}

# ---- fixed values: statuses, exit codes, actions ----------------------------------------------------------
APPROVED, BLOCKED, ATTENTION = "APROVADO", "BLOQUEADO", "ATENCAO"
EXIT_CODES = {APPROVED: 0, BLOCKED: 1, ATTENTION: 2}
EXIT_ERROR = 3
ACTIONS = {
    APPROVED: "Prosseguir com a investigação do problema no Manager.",
    BLOCKED: "Devolver o chamado ao solicitante cobrando os itens pendentes.",
    ATTENTION: "Investigar manualmente: o sintoma não foi reconhecido.",
}
STATUS_TITLES = {
    APPROVED: "✅ SUCESSO - PRONTO PARA ANÁLISE TÉCNICA",
    BLOCKED: "❌ BLOQUEADO - FALTAM DADOS",
    ATTENTION: "⚠️ ATENÇÃO - ANÁLISE HUMANA NECESSÁRIA",
}

# ---- fixed values: evidence items -------------------------------------------------------------------------
ITEM_TIME = "Horário da ocorrência"
ITEM_PHONE = "Número do Telefone/Alvo"
ITEM_ARTIFACT = "Print da tela, log de console ou anexo (imagem/PDF/log)"
TIME_PATTERN = r"\b(?:[01]?\d|2[0-3])\s*(?::|h)\s*[0-5]\d\b|\b(?:[01]?\d|2[0-3])\s*h(?:s|rs)?\b|\b(?:as|às)\s+(?:[01]?\d|2[0-3])\s*horas?\b"
ARTIFACT_WORDS = ("anexo", "anexos", "anexado", "anexada", "anexei", "print", "prints", "screenshot", "captura", "imagem", "foto", "evidencia", "evidência", "console", "log", "logs")

# ---- fixed values: ticket blocks --------------------------------------------------------------------------
BLOCKS = ("detalhes", "info solicitante", "categorizacao", "info demandante", "info arquivo", "info fornecedor")
ANALYSIS_BLOCK = "detalhes"
NARRATIVE_FIELD = "detalhe1"
FIELD_DELIMITER = r"\s*->\s*"
HEADER_LINE = r"^\s*[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ\s]{2,40}?\s*:?\s*$"

# ---- fixed values: entity kinds, masks, cues --------------------------------------------------------------
HIGH, MEDIUM = "ALTA", "MEDIA"
MASKS = {
    "CPF": "[CPF_MASK]",
    "CNPJ": "[CNPJ_MASK]",
    "TELEFONE": "[TELEFONE_MASK]",
    "CONTA": "[CONTA_MASK]",
    "VALOR": "[VALOR_MASK]",
    "EMAIL": "[EMAIL_MASK]",
}
VISIBLE_KINDS = ("PROTOCOLO", "MATRICULA", "IP")
AREA_CODES = (
    "11", "12", "13", "14", "15", "16", "17", "18", "19", "21", "22", "24", "27", "28", "31", "32", "33", "34", "35", "37", "38",
    "41", "42", "43", "44", "45", "46", "47", "48", "49", "51", "53", "54", "55", "61", "62", "63", "64", "65", "66", "67", "68", "69",
    "71", "73", "74", "75", "77", "79", "81", "82", "83", "84", "85", "86", "87", "88", "89", "91", "92", "93", "94", "95", "96", "97", "98", "99",
)
PHONE_CUES = r"\b(?:telefones?|tels?|fones?|celular(?:es)?|cels?|ramal|ramais|contatos?|whatsapp|zap)\b"
CPF_CUES = r"\b(?:cpf|documentos?|docs?)\b"
PROTOCOL_CUES = r"\b(?:protocolos?|chamados?|requisi[cç][aã]o|req|ticket|incidente|ordem de servi[cç]o|n[uú]mero)\b"
CUE_GAP = r"[\s:.=-]{0,3}"

#: (priority, kind, confidence, what must stand before, the span, what must follow, ignore case, validator)
ENTITY_RULES = (
    (10, "EMAIL", HIGH, r"", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b", r"", False, None),
    (11, "CNPJ", HIGH, r"", r"\b\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}\b", r"", False, None),
    (12, "CPF", HIGH, r"", r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", r"", False, None),
    (13, "VALOR", HIGH, r"", r"R\$\s*\d{1,3}(?:\.\d{3})*,\d{2}\b", r"", True, None),
    (14, "IP", HIGH, r"", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"", False, None),
    (20, "PROTOCOLO", HIGH, PROTOCOL_CUES + CUE_GAP, r"\d{6,14}", r"\b", True, None),
    (21, "CPF", HIGH, CPF_CUES + CUE_GAP, r"\d{11}|\d{3}\.\d{3}\.\d{3}-\d{2}", r"\b", True, None),
    (22, "TELEFONE", HIGH, PHONE_CUES + CUE_GAP, r"(?:\+?55[\s-]?)?(?:\(?\d{2}\)?[\s-]?)?\d{4,5}[\s-]?\d{4}", r"\b", True, None),
    (23, "CONTA", HIGH, r"", r"\b(?:ag[eê]ncia|ag|cc|conta)\s*:?\s*\d{3,5}[-.]?\d{1,2}\b", r"", True, None),
    (30, "TELEFONE", HIGH, r"", r"(?:\+55\s*)?\(\d{2}\)\s*9?\d{4}[-\s]?\d{4}\b", r"", False, None),
    (31, "TELEFONE", HIGH, r"", r"(?:\+55\s*)?\b\d{2}\s+9?\d{4}[-\s]\d{4}\b", r"", False, None),
    (32, "TELEFONE", HIGH, r"", r"\b9?\d{4}-\d{4}\b", r"", False, None),
    (40, "MATRICULA", HIGH, r"", r"\bp\d{6}\b", r"", True, None),
    (50, "TELEFONE", MEDIUM, r"", r"\b\d{10,11}\b", r"", False, "phone"),
    (51, "CPF", MEDIUM, r"", r"\b\d{11}\b", r"", False, "not phone"),
    (52, "CNPJ", MEDIUM, r"", r"\b\d{14}\b", r"", False, None),
)

# ---- fixed values: anchor texts ---------------------------------------------------------------------------
ANCHORS = (
    (UX, "botao travou nao responde ao clique"),
    (UX, "tela branca sistema congelou durante o uso"),
    (UX, "nao foi possivel realizar a tabulacao do atendimento"),
    (UX, "relatorio nao carrega pagina fica girando"),
    (UX, "erro ao mutar o audio pelo botao da interface"),
    (UX, "sistema lento travando ao abrir a tela de atendimento"),
    (UX, "aplicacao fechou sozinha apresentou erro na tela"),
    (AUDIO, "ligacao caiu no meio do atendimento com o cliente"),
    (AUDIO, "voz muda cliente nao escuta o agente"),
    (AUDIO, "audio picotando cortando durante a chamada"),
    (AUDIO, "chamada robotica com delay e atraso na voz"),
    (AUDIO, "softphone sem som nao sai audio na ligacao"),
    (AUDIO, "queda abrupta da chamada telefonica em linha ativa"),
    (AUDIO, "ruido e mudez repentina no audio do headset"),
    (AUDIO, "chamada caiu sozinha varias vezes seguidas"),
    (AUDIO, "ligacao derrubada sem motivo durante a conversa"),
    (QUEUE, "agentes disponiveis mas clientes parados na fila"),
    (QUEUE, "cliente nao entra na fila de atendimento"),
    (QUEUE, "fila travada nao distribui chamadas"),
    (QUEUE, "roteamento nao direciona a chamada para o agente"),
    (QUEUE, "pausa indevida agente logado nao recebe chamada"),
    (QUEUE, "skill errada atribuida ao agente na distribuicao"),
    (QUEUE, "agente ocioso enquanto a fila acumula clientes aguardando"),
    (UNKNOWN, "ferias salario folha de pagamento beneficio adicional"),
    (UNKNOWN, "nota fiscal reembolso despesa orcamento financeiro"),
    (UNKNOWN, "compra de cadeira mesa mobiliario material de escritorio"),
    (UNKNOWN, "troca de senha esquecida reset de credencial bloqueada"),
    (UNKNOWN, "criacao de login novo perfil permissao de acesso rh"),
    (UNKNOWN, "bom dia boa tarde obrigado agradeco abraco"),
    (UNKNOWN, "andamento status previsao do meu pedido protocolo"),
    (UNKNOWN, "mudanca de setor departamento e endereco cadastral"),
    (UNKNOWN, "instalacao de programa office pacote na maquina nova"),
    (UNKNOWN, "duvida sobre politica interna norma e procedimento"),
)
PROBE_TEXT = "a ligacao caiu no meio da chamada"

# ---- fixed values: log signatures, in order ---------------------------------------------------------------
SIGNATURES = (
    (UX, "HTTP 5xx Server Error", r"(?:\b5\d{2}\b[^\n]{0,80}?(?:internal server error|http)|(?:internal server error|http)[^\n]{0,80}?\b5\d{2}\b)"),
    (UX, "JS Uncaught Exception", r"uncaught \w*error"),
    (UX, "JS Heap Overflow", r"heap out of memory"),
    (AUDIO, "Jitter Alto", r"jitter\D{0,40}\d+\s*ms"),
    (AUDIO, "Perda de Pacotes (UDP)", r"packet loss"),
    (AUDIO, "SIP Timeout/Erro", r"sip/4\d{2}"),
    (QUEUE, "Fila ACD Overflow", r"acd_queue[^\n]{0,80}(?:error|overflow)"),
    (QUEUE, "Divergência de Estado do Agente", r"agent_state[^\n]{0,80}mismatch"),
    (QUEUE, "Sem Agente Disponível", r"routing_engine[^\n]{0,80}no available agent"),
)

# ---- fixed values: file kinds -----------------------------------------------------------------------------
LOG_EXTENSIONS = (".txt", ".log", ".csv", ".json", ".out")
VISUAL_EXTENSIONS = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".pdf")
ARCHIVE_EXTENSIONS = (".zip",)

# ---- fixed values: messages -------------------------------------------------------------------------------
EMPTY_TICKET = "O texto do chamado está vazio."
INCOMPLETE_PAYLOAD = "Resposta da API sem id ou texto do chamado."
NO_TICKET = "Chamado não encontrado."
TEXT_NEEDED = "Campo 'texto' é obrigatório e não pode estar vazio."
TEXT_NEEDED_DETAIL = "envie JSON {'texto': '...'} ou um campo de formulário 'texto'"
TOO_LARGE = "Envio excede o limite de {limit}."
BAD_ATTACHMENT = "Anexo inválido."
INTERNAL_ERROR = "Erro interno ao processar o chamado."
NO_RESOURCE = "Recurso não encontrado."
SOURCE_NEEDED = "informe --text, --text-file, --api-source ou --interactive"
SLUGS = {
    EMPTY_TICKET: "chamado-nao-carregado",
    INCOMPLETE_PAYLOAD: "chamado-nao-carregado",
    TEXT_NEEDED: "requisicao-invalida",
    TOO_LARGE: "envio-muito-grande",
    BAD_ATTACHMENT: "anexo-invalido",
    INTERNAL_ERROR: "erro-interno",
    NO_RESOURCE: "erro-http",
}

# ---- fixed values: lines of the text report ---------------------------------------------------------------
REPORT = {
    "ticket": "[CHAMADO]          : ",
    "text": "[TEXTO ANALISADO]  : ",
    "symptom": "[SINTOMA INFERIDO] : ",
    "confidence": " (Confiança: ",
    "files": "[ANEXOS]           : %d log(s), %d evidência(s) visual(is), %d outro(s)",
    "entities": "[DADOS SENSÍVEIS]  : ",
    "status": "[STATUS]           : ",
    "action": "[AÇÃO NECESSÁRIA]  : ",
    "return": "Devolver chamado ao solicitante cobrando: ",
    "evidence": "[EVIDÊNCIAS]",
    "met": "  [OK  ] ",
    "lacking": "  [FALTA] ",
    "no hits": "[ANÁLISE DE LOG]   : Nenhuma assinatura de erro conhecida encontrada.",
    "hits": "[ANÁLISE DE LOG]   : %d ocorrência(s) em %d arquivo(s)",
    "first": " (exibindo os primeiros)",
    "confirmed": "[CONFIRMAÇÃO]      : Causa técnica no log confirma o sintoma relatado.",
}
#: each is cut where the log's cause and the text's symptom go
REPORT_DIVERGENCE = ("[⚠️ DIVERGÊNCIA]    : Log aponta causa técnica de '", "', mas o texto do chamado indica '", "'. Revisar antes de prosseguir.")
REPORT_HINT = ("[INDÍCIO TÉCNICO]  : O log aponta '", "'. Como o texto não permitiu inferir o sintoma, use o log como ponto de partida.")
