"""The MIME types of file names.

FIXED VALUES: the table of the Python 3.13 standard library, so that a name has the same type under
any interpreter. One line a type, with its suffixes.
"""

_TYPES = """
text/javascript .js .mjs
application/json .json
application/manifest+json .webmanifest
application/msword .doc .dot .wiz
application/n-quads .nq
application/n-triples .nt
application/octet-stream .bin .a .dll .exe .o .obj .so
application/oda .oda
application/pdf .pdf
application/pkcs7-mime .p7c
application/postscript .ps .ai .eps
application/trig .trig
application/vnd.apple.mpegurl .m3u .m3u8
application/vnd.ms-excel .xls .xlb
application/vnd.ms-powerpoint .ppt .pot .ppa .pps .pwz
application/wasm .wasm
application/x-bcpio .bcpio
application/x-cpio .cpio
application/x-csh .csh
application/x-dvi .dvi
application/x-gtar .gtar
application/x-hdf .hdf
application/x-hdf5 .h5
application/x-latex .latex
application/x-mif .mif
application/x-netcdf .cdf .nc
application/x-pkcs12 .p12 .pfx
application/x-pn-realaudio .ram
application/x-python-code .pyc .pyo
application/x-sh .sh
application/x-shar .shar
application/x-shockwave-flash .swf
application/x-sv4cpio .sv4cpio
application/x-sv4crc .sv4crc
application/x-tar .tar
application/x-tcl .tcl
application/x-tex .tex
application/x-texinfo .texi .texinfo
application/x-troff .roff .t .tr
application/x-troff-man .man
application/x-troff-me .me
application/x-troff-ms .ms
application/x-ustar .ustar
application/x-wais-source .src
application/xml .xsl .rdf .wsdl .xpdl
application/zip .zip
audio/3gpp .3gp .3gpp
audio/3gpp2 .3g2 .3gpp2
audio/aac .aac .adts .loas .ass
audio/basic .au .snd
audio/mpeg .mp3 .mp2
audio/opus .opus
audio/x-aiff .aif .aifc .aiff
audio/x-pn-realaudio .ra
audio/x-wav .wav
image/avif .avif
image/bmp .bmp
image/gif .gif
image/ief .ief
image/jpeg .jpg .jpe .jpeg
image/heic .heic
image/heif .heif
image/png .png
image/svg+xml .svg
image/tiff .tiff .tif
image/vnd.microsoft.icon .ico
image/webp .webp
image/x-cmu-raster .ras
image/x-portable-anymap .pnm
image/x-portable-bitmap .pbm
image/x-portable-graymap .pgm
image/x-portable-pixmap .ppm
image/x-rgb .rgb
image/x-xbitmap .xbm
image/x-xpixmap .xpm
image/x-xwindowdump .xwd
message/rfc822 .eml .mht .mhtml .nws
text/css .css
text/csv .csv
text/html .html .htm
text/markdown .md .markdown
text/n3 .n3
text/plain .txt .bat .c .h .ksh .pl .srt
text/richtext .rtx
text/rtf .rtf
text/tab-separated-values .tsv
text/vtt .vtt
text/x-python .py
text/x-rst .rst
text/x-setext .etx
text/x-sgml .sgm .sgml
text/x-vcard .vcf
text/xml .xml
video/mp4 .mp4
video/mpeg .mpeg .m1v .mpa .mpe .mpg
video/quicktime .mov .qt
video/webm .webm
video/x-msvideo .avi
video/x-sgi-movie .movie
"""

TYPES_MAP: dict[str, str] = {suffix: line.split()[0] for line in _TYPES.strip().splitlines() for suffix in line.split()[1:]}
SUFFIX_MAP: dict[str, str] = {".svgz": ".svg.gz", ".tgz": ".tar.gz", ".taz": ".tar.gz", ".tz": ".tar.gz", ".tbz2": ".tar.bz2",
                              ".txz": ".tar.xz"}
ENCODINGS: list[str] = [".Z", ".br", ".bz2", ".gz", ".xz"]
