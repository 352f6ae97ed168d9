"""Corrections of recognised text, as data (Portuguese for the most part)."""

#: Pattern, flags and replacement, applied in this order (fixed values).  \b is a boundary of ASCII words.
RULES = r"""
6timo		ótimo
6tima		ótima
6timas		ótimas
6timos		ótimos
N&o\b		Não
n&o\b		não
N&\b		Nã
n&\b		nã
\bEnt8o\b		Então
\bent8o\b		então
\bEntdo\b		Então
\bentdo\b		então
\bEntao\b		Então
\bentao\b		então
\bEntédo\b		Então
\bentédo\b		então
\bEnt&o\b		Então
\bent&o\b		então
\bndo\b		não
\bNdo\b		Não
\bnao\b		não
\bNao\b		Não
c[&¢]ao\b		ção
c[&¢]oes\b		ções
c[&¢]des\b		ções
cgao\b		ção
cgdes\b		ções
g¢ao\b		ção
cg&o\b		ção
(ã)do\b	i	$1ão
\bvocé\b		você
\bVocé\b		Você
\bvocê\b		você
\bvoce\b		você
\bVoce\b		Você
\bcopia\b		cópia
\bcdpia\b		cópia
\bcépia\b		cópia
\bcopias\b		cópias
\bneg6cio		negócio
\bneg6cios		negócios
\bnegdcio		negócio
\bnegdcios		negócios
\bpropésito		propósito
\bproposito		propósito
\bpara\s+que\b	i	para que
\bSUCEeSSO\b	i	sucesso
\bpromog¢do\b		promoção
\bpromocéo\b		promoção
\bconclus&o\b	i	conclusão
\bintroduc&o\b	i	introdução
\bdefini[cg]&o\b	i	definição
\bdecis&o\b	i	decisão
\bfracasso\b	i	fracasso
\braz&o\b	i	razão
\bRaz&o\b		Razão
\bcorag&o\b	i	coração
\binformagdes\b	i	informações
\binformacdes\b	i	informações
\binformag[&¢]es\b	i	informações
\bsitua[c¢]oes\b	i	situações
\bsitua¢oes\b	i	situações
\bprovocagdes\b	i	provocações
\bgravacdes\b	i	gravações
\bredacéo\b	i	redação
\bredac&o\b	i	redação
\bredacgéo\b	i	redação
\bREDACAQ\b		REDAÇÃO
\bintencéo\b	i	intenção
\bintengéo\b	i	intenção
\batencao\b	i	atenção
\batenc&o\b	i	atenção
\batencéo\b	i	atenção
\bdiferengca\b	i	diferença
\bdiferenca\b	i	diferença
\bdemiss&o\b	i	demissão
\bdemisséo\b	i	demissão
\bconstipacgao\b	i	constipação
\bconstipac&o\b	i	constipação
\besforco\b	i	esforço
\besfor¢o\b	i	esforço
\bcomecou\b	i	começou
\bcomecei\b	i	comecei
\bcomecgou\b	i	começou
\bcomecéo\b	i	começão
\bmudanga\b	i	mudança
\bmudanca\b	i	mudança
\besperancga\b	i	esperança
\besperanca\b	i	esperança
\bprépria\b		própria
\bpropria\b		própria
\bpréprio\b		próprio
\bproprio\b		próprio
\bhipotecérios\b	i	hipotecários
\bhipotecarios\b	i	hipotecários
\banuncios\b	i	anúncios
\banuncio\b	i	anúncio
\banlncios\b	i	anúncios
\banincios\b	i	anúncios
\bandncios\b	i	anúncios
\bandncio\b	i	anúncio
\bpaginas\b	i	páginas
\bpagina\b	i	página
\bnumero\b	i	número
\bnumeros\b	i	números
\bpadrdes\b	i	padrões
\bpadroes\b	i	padrões
\bbotéao\b	i	botão
\bbotdo\b	i	botão
\bbotao\b	i	botão
\btimulos\b	i	túmulos
\btumulos\b	i	túmulos
\bpermanecerédo\b	i	permanecerão
\bvenderdo\b	i	venderão
\bestdo\b	i	estão
\bestéo\b	i	estão
\bseréo\b	i	serão
\bfaréo\b	i	farão
\btornaréo\b	i	tornarão
\bescritdério\b	i	escritório
\bescritorio\b	i	escritório
\bapéndice\b	i	apêndice
\bequilibrio\b	i	equilíbrio
\bbeneficio\b	i	benefício
\bbenefícios\b	i	benefícios
\bobvios\b	i	óbvios
\bdbvios\b	i	óbvios
\s[®]\s		 
^®\s	m	- 
\b0\s+(que|quê)\b	i	o $1
\b0\s+(mais|menos|melhor|pior)\b	i	o $1
\bcom\s+0\b		com o
\bpara\s+0\b		para o
\bpelo\s+0\b		pelo o
\bde\s+0\b		de o
"""

#: Whole words and what they stand for, whatever their case (fixed values).
WORDS = """
educacao=educação comunicacao=comunicação organizacao=organização informacao=informação apresentacao=apresentação publicacao=publicação
aplicacao=aplicação operacao=operação populacao=população situacao=situação classificacao=classificação configuracao=configuração
explicacao=explicação motivacao=motivação conversacao=conversação negociacao=negociação avaliacao=avaliação recomendacao=recomendação
concentracao=concentração participacao=participação preparacao=preparação educacdo=educação comunicacdo=comunicação organizacdo=organização
informacdo=informação apresentacdo=apresentação coracdo=coração questdo=questão opinido=opinião padrao=padrão irmao=irmão alemao=alemão
cidadao=cidadão capitao=capitão orgao=órgão maos=mãos paes=pães caes=cães voce=você tambem=também alguem=alguém ninguem=ninguém alem=além porem=porém
armazem=armazém ja=já atras=atrás facil=fácil dificil=difícil rapido=rápido unico=único publico=público basico=básico classico=clássico
classicos=clássicos pratico=prático automatico=automático tambéem=também familia=família pais=país possivel=possível impossivel=impossível
incrivel=incrível terrivel=terrível visivel=visível musica=música ultimo=último conteudo=conteúdo saude=saúde empreendedor=empreendedor
bemsucedidos=bem-sucedidos bemsucedido=bem-sucedido
"""
