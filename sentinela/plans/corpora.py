"""Inline corpora: a synthetic one over customer keys, and labelled sentences."""

from __future__ import annotations

_N = "lpad(CAST(k % 10000 AS VARCHAR(20)), 4, '0')"
_CPF = "substr(d, 1, 3) || '.' || substr(d, 4, 3) || '.' || substr(d, 7, 3) || '-' || CAST(v1 AS VARCHAR(2)) || CAST(v2 AS VARCHAR(2))"
_W1 = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {10 - i}" for i in range(9))
_W2 = " + ".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {11 - i}" for i in range(9))
_TEXTS = (
    f"'CPF do cliente: ' || {_CPF} || ', placa ABC-' || {_N} || '. Vamos resolver.'",
    f"'CNPJ 11.222.333/0001-81 e email user' || {_N} || '@example.com.br para contato.'",
    f"'RG: 12.345.678-9, CEP 01310-' || substr({_N}, 2, 3) || '. ISO-' || {_N} || ' não é placa.'",
    f"'Tel: (11) 9' || {_N} || '-4321. Nome: Maria Silva, paciente José André.'",
    f"'Processo 1234567-89.2024.8.13.' || {_N} || ' e MASP 1234567-8.'",
    "'Texto limpo sem dados. Isso sempre funciona e todos os testes passam.'",
    "''",
    f"'REDS 2024' || {_N} || ', nascimento: 10/10/1980.'",
    f"'SUS 100 0000 0000 0001; NIS 123.45678.90-1; título 1234 5678 ' || {_N} || '.'",
    "'A SITUAÇÃO XYZW (ABCD) foi tratada. Segundo dados da ANVISA, com certeza.'",
    "'CNH: 12345678901 portador de diabetes tipo dois. Placa BRA2E19.'",
    f"'CPF ' || {_CPF} || ' e CPF ' || {_CPF} || ', email a' || {_N} || '@b.com, fone (31) 3333-' || {_N}",
    f"'AKIAABCDEFGHIJKL' || {_N} || ' e sk_live_abcdefghijkl' || {_N} || '; bearer abcdefghijklmnopqrst' || {_N}",
    f"'postgres://user:pass@db' || {_N} || '/x e api_key = \"abcdefghijklmnopqrst' || {_N} || '\" -----BEGIN RSA PRIVATE KEY-----'",
    f"'BO nº 2024/09' || {_N} || ', IPL ' || {_N} || '/2024, REDS-2024-00123' || {_N} || '/123 e TC-' || {_N} || '/2024.'",
)
#: The same SQL runs in Spark and DuckDB.
SYNTHETIC = (
    "SELECT doc_id, CASE k % 15 "
    + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS))
    + f""" END AS text FROM (
  SELECT k AS doc_id, k, d, v1, CASE WHEN ({_W2} + v1 * 2) * 10 % 11 >= 10 THEN 0 ELSE ({_W2} + v1 * 2) * 10 % 11 END AS v2 FROM (
    SELECT k, d, CASE WHEN ({_W1}) * 10 % 11 >= 10 THEN 0 ELSE ({_W1}) * 10 % 11 END AS v1 FROM (
      SELECT c_custkey AS k, lpad(CAST((c_custkey * 7919 + 100000007) % 1000000000 AS VARCHAR(20)), 9, '0') AS d FROM customer) x) y) z"""
)

_CNPJ, _CNS = "'10.000.000/0010-36'", "'100 0000 0000 0007'"
_SPOKEN = (
    f"'Nome completo: Ana Souza, CPF ' || {_CPF} || ', e Nome do Suspeito: Bruno de Lima ' || {_N}",
    "'O Dr. Carlos Alberto Nunes e a Sra. Lia Prado vieram. Prof Rui Costa faltou.'",
    f"'JOSE DA SILVA foi ouvido; MARIA SOUZA LIMA depois; CPF RG CNH ' || {_N}",
    "'Testemunha: Paulo Reis. Vítima - Marta Dias, Preso: Igor Melo.'",
    "'Assinado por: Clara Mendes. Assinatura: Davi Rocha; Responsável técnico: Elis Campos.'",
    "'Filho de Marta Dias e irmão do Hugo Lopes, pai da Nina Alves.'",
    "'O delegado (Otto Braga) e a escrivã (Vera Matos) assinam.'",
    "'1. Lara Pinto' || chr(10) || '- Mauro Teles' || chr(10) || '• Rita Cunha' || chr(10) || '2) nada aqui'",
    "'O inspetor Saulo Freitas e o cabo: Tiago Barros chegaram; SOLDADO Ugo Viana também.'",
    "'Paciente: Yara Moraes, cliente Zeca Duarte e Representante legal: Alan Brito.'",
    f"'CPF ' || {_CPF} || ' e 123.456.789-00; CNPJ ' || {_CNPJ} || ' e 11.222.333/0001-80'",
    f"'SUS ' || {_CNS} || ' e 100 0000 0000 0001; título de eleitor: 1000 0000 0329 e 1234 5678 ' || {_N}",
    f"'PIS 100.00000.09-1 e 123.45678.90-1; CNH: 10000000091; RG: 12.345.678-9; tel (11) 9' || {_N} || '-4321 e 551199999' || {_N} || '7'",
    f"'a' || {_N} || '@b.com; MASP 1234567-8; REDS 2024' || {_N} || '; ABC-' || {_N} || ', ISO-' || {_N} || ', BRA2E19, CEP 01310-100, processo 1234567-89.2024.8.13.' || {_N}",
)
#: Every name rule and every check-digit pattern, with valid and invalid digits.
SPOKEN = SYNTHETIC[: SYNTHETIC.index("CASE k")] + f"CASE k % {len(_SPOKEN)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_SPOKEN)) + SYNTHETIC[SYNTHETIC.index(" END AS text FROM") :]

# Labelled texts for the evaluation (text, expected patterns).
LABELLED: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("CPF do cliente: 123.456.789-09", ("cpf",)),
    ("cpf 12345678909", ("cpf",)),
    ("CPF: 000.000.000-00", ("cpf",)),
    ("Sem CPF aqui", ()),
    ("Código 12345-67 não é CPF", ()),
    ("CNPJ: 11.222.333/0001-81", ("cnpj",)),
    ("empresa cnpj 11222333000181", ("cnpj",)),
    ("CNPJ 00.000.000/0000-00", ("cnpj",)),
    ("processo 1234567", ()),
    ("RG: 12.345.678-9", ("rg",)),
    ("Registro Geral 123456789", ("rg",)),
    ("Contato: joao@example.com.br", ("email",)),
    ("email: test@test.com", ("email",)),
    ("site sem @ nao e email", ()),
    ("Tel: (11) 99999-9999", ("telefone",)),
    ("fone 11988887777", ("telefone",)),
    ("+55 21 3333-4444", ("telefone",)),
    ("CEP: 01310-100", ("cep",)),
    ("cep 01310100", ("cep",)),
    ("Nome: João Silva, CPF: 111.444.777-35, email: joao@mail.com, Tel: (11) 91234-5678", ("cpf", "email", "telefone")),
    ("Relatório de atividades do mês de março de 2024.", ()),
    ("O valor total foi de R$ 1.234,56 aprovado.", ()),
    ("Versão 1.2.3-456 do sistema", ()),
    ("O código de barras é 789456123", ()),
    ("MASP 1234567-8", ("masp",)),
    ("Placa: ABC-1234", ("placa_antiga",)),
    ("placa BRA2E19", ("placa_antiga",)),
)
# End of fixed values.

# Review sentences (id, pattern, text, should match).
_SENTENCES: tuple[tuple[str, str, str, bool], ...] = (
    ("bo-pos-1", "pcmg:bo_numero", "O BO nº 2024/098765 foi registrado na delegacia da Savassi.", True),
    ("bo-pos-2", "pcmg:bo_numero", "Conforme BO no. 2023/001234, o furto ocorreu na Av. Afonso Pena.", True),
    ("bo-pos-3", "pcmg:bo_numero", "Favor anexar o BO n° 2025/567890 ao processo.", True),
    ("bo-pos-4", "pcmg:bo_numero", "A vítima declarou que registrou BO 2022/000042 na 14ª DP.", True),
    ("bo-pos-5", "pcmg:bo_numero", "Referenciado no BO nº 2024/112233, consta que o veículo foi encontrado.", True),
    ("bo-neg-1", "pcmg:bo_numero", "O balanço patrimonial (BP) 2024 foi aprovado em assembleia.", False),
    ("bo-neg-2", "pcmg:bo_numero", "Número do pedido: 2024/098765 — produto eletrônico.", False),
    ("ipl-pos-1", "pcmg:inquerito", "O IPL 1234/2024 está sob sigilo judicial.", True),
    ("ipl-pos-2", "pcmg:inquerito", "Conforme IP-5678/2023, o suspeito foi identificado.", True),
    ("ipl-pos-3", "pcmg:inquerito", "IPl 0099/2025 foi encaminhado ao MPMG.", True),
    ("ipl-pos-4", "pcmg:inquerito", "A testemunha foi ouvida no inquérito IPL-2341/2022.", True),
    ("ipl-pos-5", "pcmg:inquerito", "Cópia do IPL 00876/2024 juntada aos autos.", True),
    ("ipl-neg-1", "pcmg:inquerito", "Placa do veículo: IPL-1234 (Mercosul, Belo Horizonte).", False),
    ("ipl-neg-2", "pcmg:inquerito", "O Instituto de Pesquisas (IPl) publicou relatório trimestral.", False),
    ("reds-pos-1", "pcmg:reds_complemento", "REDS-2024-001234567/123 foi lavrado no posto policial.", True),
    ("reds-pos-2", "pcmg:reds_complemento", "Conforme REDS 2023/098765432-001, houve resistência.", True),
    ("reds-pos-3", "pcmg:reds_complemento", "O REDS2025-111222333/456 registra o flagrante.", True),
    ("reds-pos-4", "pcmg:reds_complemento", "Número REDS-2022-987654321-099 consta no histórico.", True),
    ("reds-pos-5", "pcmg:reds_complemento", "REDS 2024/112233445/088 gerado automaticamente pelo sistema.", True),
    ("reds-neg-1", "pcmg:reds_complemento", "REDS 2024/1234 sem dígito de delegacia — formato incompleto.", False),
    ("reds-neg-2", "pcmg:reds_complemento", "O sistema REDS foi atualizado em 15/06/2024.", False),
    ("tc-pos-1", "pcmg:termo_circunstanciado", "O TC-1234/2024 foi lavrado por vias de fato.", True),
    ("tc-pos-2", "pcmg:termo_circunstanciado", "Conforme TC 0567/2023, houve infração de menor potencial ofensivo.", True),
    ("tc-pos-3", "pcmg:termo_circunstanciado", "TC-00099/2025 encaminhado ao JECRIM.", True),
    ("tc-pos-4", "pcmg:termo_circunstanciado", "A parte apresentou TC 0042/2022 como documento.", True),
    ("tc-pos-5", "pcmg:termo_circunstanciado", "Registrado no TC-123/2024 o ocorrido na praça pública.", True),
    ("tc-neg-1", "pcmg:termo_circunstanciado", "O TC (Tribunal de Contas) publicou parecer sobre o contrato.", False),
    ("tc-neg-2", "pcmg:termo_circunstanciado", "Temperatura controlada (TC): 37°C no momento da coleta.", False),
)
# End of fixed values.
_ANSWERS = {"bo-pos-2": "", "ipl-pos-3": "n", "ipl-neg-1": "n", "reds-pos-1": "p", "reds-pos-4": "N ", "tc-pos-1": "x"}
#: Review sentences with a reviewer's answer: (id, pattern, text, should match, answer).
REVIEW: tuple[tuple[str, str, str, bool, str], ...] = tuple((*row, _ANSWERS.get(row[0], "s")) for row in _SENTENCES) + (
    # Two of one kind in a sentence, and one that is expected and has none.
    ("own-1", "pcmg:bo_numero", "O BO 2023/123456 foi aditado e o BO 2023/123457 anexado.", True, "s"),
    ("own-2", "pcmg:bo_numero", "O boletim foi perdido.", True, "s"),
)
